"""Column functions for annotation comments: subtypes, labels, identities, priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other spellings of subtypes, and what each subtype is called.
ALIASES = {"strikethrough": "strikeout", "typewriter": "freetext", "noteinline": "freetext", "notelinked": "text"}
KIND_LABELS = {
    "highlight": "Highlight", "underline": "Underline", "squiggly": "Squiggle", "strikeout": "Strike Out",
    "text": "Pop-up Note", "note-linked": "Pop-up Note",
    "freetext": "Inline Note", "typewriter": "Inline Note", "note-inline": "Inline Note",
    "ink": "Freehand Line", "line": "Line", "straight-line": "Line",
    "square": "Rectangle", "geomsquare": "Rectangle", "rectangle": "Rectangle",
    "circle": "Circle", "geomcircle": "Circle", "ellipse": "Circle", "polygon": "Polygon", "stamp": "Stamp",
}
OTHER_KIND = "Annotation"
TEXT_MARKUP = ("highlight", "underline", "squiggly", "strikeout")
# Points of what a comment has, when duplicates are merged.
POINTS = {"annotation_id": 110, "uid": 55, "editor": 22, "text": 12, "note": 8, "modified": 5, "rect": 3}


def _plain(column: Column) -> Column:
    return F.lower(F.trim(F.coalesce(column, F.lit(""))))


def _lookup(column: Column, table: dict[str, str], other: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, column), other)


def subtype_token(subtype: Column) -> Column:
    """A subtype's letters and digits in lower case, other spellings made one; '' for null."""
    token = F.regexp_replace(_plain(subtype), "[^a-z0-9]+", "")
    return _lookup(token, ALIASES, token)


def kind_label(subtype: Column) -> Column:
    """What a subtype is called; anything unknown or null is an annotation."""
    return _lookup(_plain(subtype), KIND_LABELS, F.lit(OTHER_KIND))


def is_text_markup(subtype: Column) -> Column:
    return _plain(subtype).isin(*TEXT_MARKUP)


def is_popup(subtype: Column) -> Column:
    return _plain(subtype) == "popup"


def is_note(has_note: Column, subtype: Column, label: Column) -> Column:
    """Whether a comment is a note: it has one, its subtype says so anywhere, or its label as a word."""
    kind = F.lower(F.coalesce(subtype, F.lit("")))
    said = kind.contains("popup") | kind.contains("text") | kind.contains("note")
    return F.coalesce(has_note, F.lit(False)) | said | F.coalesce(label, F.lit("")).rlike(r"(?i)\b(note|comment|sticky)\b")


def first_text(*columns: Column) -> Column:
    """The first text that is not blank, trimmed; '' where none is."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def stable_key(page: Column, annotation_id: Column, uid: Column, source: Column, row_id: Column) -> Column:
    """A comment's identity by the strongest thing it has: annotation, editor, or its source's id."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return (
        F.when(text(annotation_id) != "", F.concat_ws(":", F.lit("ann"), text(page), text(annotation_id)))
        .when(text(uid) != "", F.concat_ws(":", F.lit("uid"), text(page), text(uid)))
        .otherwise(F.concat_ws(":", F.lit("src"), text(source), text(page), text(row_id)))
    )


def memory_keys(stable: Column, page: Column, annotation_id: Column, uid: Column, row_id: Column) -> Column:
    """Up to seven keys a comment's text is remembered by, strongest first; null or '' parts give none."""

    def keys(name: str, value: Column) -> list[Column]:
        there = F.coalesce(value.cast("string"), F.lit("")) != ""
        text = value.cast("string")
        return [F.when(there, F.concat_ws(":", F.lit(name), page.cast("string"), text)), F.when(there, F.concat_ws(":", F.lit(name), F.lit("any"), text))]

    first = F.when(F.coalesce(stable, F.lit("")) != "", F.concat(F.lit("stable:"), stable))
    every = F.array(first, *keys("ann", annotation_id), *keys("uid", uid), *keys("id", row_id))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))


def merge_points(annotation_id: Column, uid: Column, source: Column, text: Column, has_note: Column, modified: Column, rect: Column) -> Column:
    """How much a comment counts when duplicates are merged."""
    there = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    tests = {
        "annotation_id": there(annotation_id),
        "uid": there(uid),
        "editor": source == "editor",
        "text": F.trim(F.coalesce(text, F.lit(""))) != "",
        "note": has_note,
        "modified": F.coalesce(modified, F.lit(0)) != 0,
        "rect": rect.isNotNull(),
    }
    return sum((F.when(tests[k], n).otherwise(0) for k, n in POINTS.items()), F.lit(0))
