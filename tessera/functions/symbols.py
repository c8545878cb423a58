"""Names, kinds and paths of code symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of the public symbol format by number, and the labels that an older map gave.
KINDS = {7: "class", 9: "constructor", 11: "enum", 12: "enum_member", 15: "field", 17: "function", 21: "interface", 26: "method", 29: "module", 30: "namespace", 41: "property", 49: "struct", 54: "type", 61: "variable"}
LEGACY_KINDS = {1: "namespace", 2: "module", 3: "class", 4: "method", 5: "property", 6: "field", 7: "constructor", 8: "enum", 9: "interface", 10: "function", 11: "variable", 12: "constant"}


def short_enclosing(symbol: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(symbol, "#+$", ""), r"\.+$", "")
    return F.substring_index(F.substring_index(s, "/", -1), "#", -1)


def shortened(names: Column, most: int = 5) -> Column:
    """The first few of a comma-separated list of symbols, each after its first slash, without spaces."""

    def short(x: Column) -> Column:
        x = F.regexp_replace(F.trim(x), r"\.+$", "")
        after = F.when(F.instr(x, "/") > 0, F.substring(x, F.instr(x, "/") + 1, F.length(x))).otherwise(x)
        return F.replace(after, F.lit(" "), F.lit(""))

    return F.array_join(F.transform(F.slice(F.split(names, ","), 1, most), short), ", ")


def display_name(symbol: Column) -> Column:
    """The last descriptor of a symbol: without its suffix, disambiguator and owners."""
    s = F.regexp_replace(symbol, r"\((\+\d+)?\)\.$", "")
    s = F.regexp_replace(s, r"[.#:/!]+$", "")
    return F.regexp_replace(F.regexp_extract(s, r"([^#/. `]+|`[^`]+`)$", 1), "`", "")


def kind_label(kind: Column, legacy: bool = False) -> Column:
    out = F.lit("unknown")
    for number, name in (LEGACY_KINDS if legacy else KINDS).items():
        out = F.when(kind == number, name).otherwise(out)
    return out


def inferred_kind(symbol: Column) -> Column:
    """From the descriptor's suffix: method, class, or property and field by the case of the member's initial."""
    member = F.regexp_extract(symbol, r"#([^#]+)\.$", 1)
    return (
        F.when(symbol.rlike(r"\((\+\d+)?\)\.$"), "method")
        .when(symbol.endswith("#"), "class")
        .when((member != "") & F.substring(member, 1, 1).rlike(r"\p{Lu}"), "property")
        .when(member != "", "field")
        .otherwise("unknown")
    )


def comparable_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
