"""Cutting page and document texts into paragraphs, sentences and words."""

from __future__ import annotations

import regex

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’\-]\p{L}[\p{L}\p{M}]*)*")
QUOTED = regex.compile(r"«[^»\n]{1,80}(?:\n[^»\n]{1,80})?»|[“„][^”“\n]{1,80}(?:\n[^”“\n]{1,80})?[”“]")
BROKEN = regex.compile(r"(?<=\p{L})[-¬=\u00AD] *\n *(?=\p{Ll})")
_BLANK = regex.compile(r"\n[ \t]*\n+")
_STOP = regex.compile(r"[.!?…]+[\"”»)\]]*(?=\s|$)")


def sentences(text: str) -> list[str]:
    """Whole sentences (with their stop), broken words mended and quoted titles left out.

    Linear in the text, however long it is and however rare its stops.
    """
    out = []
    for paragraph in _BLANK.split(text):
        flat, at = QUOTED.sub(" ", BROKEN.sub("", paragraph)).replace("\n", " "), 0
        for m in _STOP.finditer(flat):
            s = flat[at : m.end()].strip()
            at = m.end()
            if WORD.search(s):
                out.append(s)
    return out


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]
