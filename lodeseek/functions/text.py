"""Column functions on text: tokens, cleaning, formats, paths, lists and tables as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lowered text; an accented letter splits a word."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def strip(text: Column) -> Column:
    """Without white space at both ends, as Python's strip."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def truncate(text: Column, most: int, mark: str = " ...[truncated]") -> Column:
    """P10: at most ``most`` characters and a mark; 0 or less is no limit."""
    return text if most <= 0 else F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def safe_name(text: Column) -> Column:
    """A file name without separators, marks and spaces; dots and underscores go at both ends."""
    return F.regexp_replace(F.regexp_replace(strip(text), r'[\\/:*?"<>|\s]+', "_"), r"^[._]+|[._]+$", "")


def document_text(*fields: Column) -> Column:
    """The non-blank fields, a line each. A null field that is present counts as the text None."""
    named = [strip(F.coalesce(f.cast("string"), F.lit("None"))) for f in fields]
    return F.concat_ws("\n", *(F.when(f != "", f) for f in named))


def digest(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(text), 1, n)


# ---- formats --------------------------------------------------------------------------------------------------------

_KINDS = {
    "csv": ("csv",),
    "excel": ("xls", "xlsx", "xlxs"),
    "tsv": ("tsv",),
    "json": ("json", "jsonl", "ndjson"),
    "parquet": ("parquet",),
    "feather": ("feather",),
    "orc": ("orc",),
    "hdf": ("hdf", "hdf5", "h5"),
    "stata": ("dta",),
    "sas": ("sas7bdat", "xpt"),
    "spss": ("sav",),
    "sqlite": ("sqlite", "sqlite3", "db"),
}
EXTENSIONS = {ext: kind for kind, exts in _KINDS.items() for ext in exts} | {"sheet": "excel"}
FORMATS = {ext: kind for ext, kind in EXTENSIONS.items() if ext != "sheet"} | {k: k for k in _KINDS} | {"csv (comma-separated values)": "csv", "ascii (csv)": "csv"}
PRIORITY = ("csv", "tsv", "json", "excel", "parquet", "feather", "orc", "hdf", "stata", "sas", "spss", "sqlite")


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.try_element_at(entries, F.coalesce(key, F.lit("")))


def clean_token(text: Column) -> Column:
    """Lowered, with single spaces and none at the ends."""
    return F.regexp_replace(F.lower(strip(text)), r"\s+", " ")


def canonical_format(declared: Column) -> Column:
    """The format of a declared name, tried with and without its spaces."""
    clean = clean_token(declared)
    return F.coalesce(_lookup(FORMATS, clean), _lookup(FORMATS, F.replace(clean, F.lit(" "), F.lit(""))))


def format_of_path(path: Column) -> Column:
    """Suffixes of the last part are tried from the right; the first known one counts."""
    name = F.element_at(F.split(F.lower(strip(path)), r"[\\/]"), -1)
    found = F.transform(F.reverse(F.slice(F.split(name, r"\."), F.lit(2), F.greatest(F.size(F.split(name, r"\.")) - 1, F.lit(0)))), lambda s: _lookup(EXTENSIONS, s))
    return F.get(F.filter(found, lambda k: k.isNotNull()), F.lit(0))


def format_of_url(url: Column) -> Column:
    """The format by the path of a URL, percent-decoded; a plus sign stays one."""
    path = F.regexp_extract(strip(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return format_of_path(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))


def resource_format(declared: Column, filename: Column, url: Column) -> Column:
    """Declared, else by file name, else by URL."""
    return F.coalesce(canonical_format(declared), format_of_path(filename), format_of_url(url))


def include_formats(spec: str) -> list[str]:
    """Formats of a comma list; names and extensions are resolved, unknown ones kept."""
    parts = [" ".join(p.lower().split()) for p in spec.split(",")]
    return list(dict.fromkeys(FORMATS.get(p) or EXTENSIONS.get(p.lstrip("."), p) for p in parts if p))


# ---- lists and tables as text ---------------------------------------------------------------------------------------


def numbered_list(text: Column) -> Column:
    """The items of a list as text without numbers, bullets and quotes; the first of equal ones counts."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda x: x != "")
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^(?:[0-9]+[).:\-]|-|\*)\s*(?=\S)", "")))
    plain = F.transform(bare, lambda x: F.regexp_replace(F.regexp_replace(x, r'^"+|"+$', ""), r"^'+|'+$", ""))
    return F.array_distinct(F.filter(plain, lambda x: x != ""))


def split_numbered(text: Column) -> Column:
    """Cut at every number with a dot, also inside an item such as 3.5; empty parts go."""
    return F.filter(F.split(text, r"[0-9]+\.\s*"), lambda x: strip(x) != "")


def table_text(columns: list[str], rows: Column) -> Column:
    """A line of column names, then a line for each row (array of arrays of strings)."""
    return F.concat_ws("\n", F.lit("Columns: " + " | ".join(columns)), F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "")), "\n"))


def parse_table_text(text: Column) -> tuple[Column, Column]:
    """P12 backwards: names and rows; short rows are filled with empty cells, long ones cut. Bars within cells split them."""
    lines = F.split(text, "\n")
    names = F.transform(F.split(F.regexp_replace(lines[0], "^Columns: ", ""), r"\|"), strip)
    rows = F.transform(
        F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: strip(x) != ""),
        lambda x: F.slice(F.concat(F.transform(F.split(x, r"\|"), strip), F.array_repeat(F.lit(""), F.size(names))), F.lit(1), F.size(names)),
    )
    return names, rows


def metadata_text(value: Column, dtype: str) -> Column:
    """Null is empty, scalars stay, the rest is JSON."""
    nested = dtype.startswith(("array", "map", "struct"))
    return F.coalesce(F.to_json(value) if nested else value.cast("string"), F.lit(""))


def make_unique(names: list[str]) -> list[str]:
    """A repeated name gets _2, _3, ...; it may meet a name that is there already."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def number(text: Column) -> Column:
    """The number that a text denotes, else null; type letters (1d, 2f) and nan denote none."""
    bare = strip(text)
    value = F.when(bare.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"), bare.try_cast("double"))
    return F.when(~F.isnan(value), value)


def duration(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)
