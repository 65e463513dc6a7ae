"""Column functions over the names of release assets and user agents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Installer formats, endings that are none, and preferred formats by platform.
INSTALLERS = ["appimage", "deb", "dmg", "exe", "msi", "pkg", "rpm", "tar.gz", "zip"]
NO_INSTALLER = [".blockmap", ".sha256", ".sha512", ".sig", ".txt", ".xml", ".yml", ".yaml"]
PREFERENCE = {
    "macos": ["dmg", "pkg", "zip"],
    "windows": ["exe", "msi"],
    "linux": ["deb", "appimage", "rpm", "tar.gz", "zip"],
    "unknown": ["dmg", "exe", "deb", "appimage", "zip"],
}


def extension(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".tar.gz"), F.lit("tar.gz")).otherwise(F.regexp_extract(low, r"\.([^.]*)$", 1))


def platform(name: Column) -> Column:
    low, ext = F.lower(name), extension(name)
    return (
        F.when(low.contains("darwin") | low.contains("mac") | ext.isin("dmg", "pkg"), "macos")
        .when(low.contains("win") | ext.isin("exe", "msi"), "windows")
        .when(low.contains("linux") | ext.isin("appimage", "deb", "rpm", "tar.gz"), "linux")
        .otherwise("unknown")
    )


def arch(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.rlike(r"\b(universal|all)\b"), "universal")
        .when(low.rlike("arm64|aarch64|armv8"), "arm64")
        .when(low.rlike("x64|x86_64|amd64|win64"), "x64")
        .otherwise("unknown")
    )


def agent_platform(agent: Column) -> Column:
    low = F.lower(F.coalesce(agent, F.lit("")))
    return (
        F.when(low.rlike("macintosh|mac os x|darwin"), "macos")
        .when(low.rlike("windows|win32|win64"), "windows")
        .when(low.rlike("linux|x11"), "linux")
        .otherwise("unknown")
    )


def agent_arch(agent: Column) -> Column:
    low = F.lower(F.coalesce(agent, F.lit("")))
    return (
        F.when(low.rlike("arm64|aarch64|armv8|apple silicon"), "arm64")
        .when(low.rlike("x86_64|x64|amd64|wow64|intel|win64"), "x64")
        .otherwise("unknown")
    )


def platform_label(p: Column) -> Column:
    return F.when(p == "macos", "macOS").when(p == "windows", "Windows").when(p == "linux", "Linux").otherwise("Unknown OS")


def arch_label(a: Column) -> Column:
    return F.when(a == "arm64", "ARM64").when(a == "x64", "x64").when(a == "universal", "Universal").otherwise("")


def installer_label(p: Column, a: Column, ext: Column) -> Column:
    shown = arch_label(a)
    return F.concat(
        platform_label(p), F.when(shown != "", F.concat(F.lit(" "), shown)).otherwise(""), F.lit(" ("), F.when(ext == "appimage", "AppImage").otherwise(F.upper(ext)), F.lit(")")
    )


def is_installer(name: Column) -> Column:
    low = F.lower(name)
    barred = low.contains("latest-mac") | low.contains("latest-linux") | low.contains("latest.yml")
    for end in NO_INSTALLER:
        barred = barred | low.endswith(end)
    return ~barred & extension(name).isin(INSTALLERS)


def format_rank(platform_: Column, ext: Column) -> Column:
    """Place of a format among those preferred on a platform; four beyond the last for others."""
    out = None
    for p, order in PREFERENCE.items():
        rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), ext), F.lit(0)) - 1, F.lit(len(order) + 4))
        if p == "unknown":
            return out.otherwise(rank)
        out = F.when(platform_ == p, rank) if out is None else out.when(platform_ == p, rank)


def arch_rank(asset: Column, wanted: Column) -> Column:
    return F.when(
        wanted == "unknown", F.when(asset == "universal", 0).when(asset == "unknown", 1).otherwise(2)
    ).otherwise(F.when(asset == wanted, 0).when(asset == "universal", 1).when(asset == "unknown", 2).otherwise(3))
