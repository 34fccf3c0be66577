"""What region, hemisphere, class, glomerulus and side a name stands for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from axonspark.functions.text import flagged, flags_sql

# The regions, the classes with the patterns that mark them in upper-cased names (first match wins), and the patterns of glomeruli and sides.
REGIONS = ("AL", "LH", "MB")
SIDES = ("", "L", "R")
CLASSES = (("ORN", "ORN"), ("PN", "PN|PROJECTION NEURON"), ("LN", "LN|LOCAL"), ("KC", "^KC|KENYON"), ("MBON", "MBON"), ("APL", "APL"), ("DAN", "DAN|PAM|PPL"))
GLOMERULUS = (("ORN_([^_;, ]+)", 1), ("(^|[ ;,])([^_;, ]+)_ORN", 2), ("(^|[ ;,])([^_;, ]+)_[lvm]?PN", 2), ("PN_([^_;, ]+)", 1))
SIDE = ("(^|[ ;,])[^ ;,]*(_|-){0}($|[ ;,])", "(^|[ ;,]){0}($|[ ;,])")


def text_of(c: Column | str) -> str:
    """The SQL of a plain column, or SQL text as it is. Label expressions are text: planned at once, where columns would be put together call by call."""
    if isinstance(c, str):
        return c
    found = re.fullmatch(r"Column<'([\w.]+)'>", str(c))
    if not found:
        raise TypeError(f"a plain column or SQL text is needed, not {c}")
    return f"`{found[1]}`" if "." not in found[1] else found[1]


def _cases(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{label}'" for test, label in pairs) + " ELSE '' END"


def region_sql(roi: str) -> str:
    """AL, LH or MB by the prefix of the upper-cased ROI, else the empty text."""
    return _cases([(f"startswith(upper({roi}), '{r}')", r) for r in REGIONS])


def hemisphere_sql(roi: str) -> str:
    """R before L. Any R or L counts that is in brackets, ends a name or is inside one: that is any but the first letter."""
    return _cases([(f"locate('{x}', upper({roi}), 2) > 0", x) for x in "RL"])


def cell_class_sql(name: str) -> str:
    return _cases([(f"upper({name}) RLIKE '{pattern}'", label) for label, pattern in CLASSES])


def glomerulus_sql(name: str) -> str:
    """The first pattern that finds a channel; case-sensitive."""
    return f"coalesce({', '.join(f"nullif(regexp_extract({name}, '{p}', {g}), '')" for p, g in GLOMERULUS)}, '')"


def side_sql(name: str) -> str:
    def hits(letter: str, word: str) -> str:
        return " OR ".join([f"upper({name}) LIKE '% {word.upper()}%'", f"lower({name}) = '{word}'", *[f"upper({name}) RLIKE '{p.format(letter)}'" for p in SIDE]])

    return _cases([(hits("R", "right"), "R"), (hits("L", "left"), "L")])


def region(roi: Column | str) -> Column:
    return F.expr(region_sql(text_of(roi)))


def hemisphere(roi: Column | str) -> Column:
    return F.expr(hemisphere_sql(text_of(roi)))


def cell_class(name: Column | str) -> Column:
    return F.expr(cell_class_sql(text_of(name)))


def glomerulus(name: Column | str) -> Column:
    return F.expr(glomerulus_sql(text_of(name)))


def side(name: Column | str) -> Column:
    return F.expr(side_sql(text_of(name)))


def traits(region: str = "region", hemisphere: str = "hemisphere") -> Column:
    """Region and hemisphere as one number with a bit for each; ``bit_or`` of it is the set of both."""
    return F.expr(f"{flags_sql(region, REGIONS)} | {flags_sql(hemisphere, SIDES, len(REGIONS))}")


def regions(bits: str) -> Column:
    return flagged(bits, REGIONS)


def hemispheres(bits: str) -> Column:
    return flagged(bits, SIDES, len(REGIONS))


def relation(a: Column, b: Column) -> Column:
    """ipsi, contra, or unknown where either side is."""
    return F.when((a == "") | (b == ""), "unknown").when(a == b, "ipsi").otherwise("contra")


def _tokens(name: Column) -> Column:
    """The words of a name, brackets around them aside."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), "[;, ]+", " ")), " ")
    return F.transform(words, lambda w: F.regexp_replace(w, r"^[()\[\]{}]+|[()\[\]{}]+$", ""))


def cell_class_loose(name: Column) -> Column:
    """Like ``cell_class``, and a KC after an underscore counts too."""
    kc = F.upper(name).contains("_KC")
    return F.when((cell_class(name) == "KC") | (kc & ~cell_class(name).isin("ORN", "PN", "LN")), "KC").otherwise(cell_class(name))


def glomerulus_by_token(name: Column) -> Column:
    """The channel in the first word that has one, whatever the case."""
    forms = (("(?i)^ORN_(.*)$", 1), ("(?i)^(.*)_ORN$", 1), ("(?i)^([^_]*)_.*$", 1), ("(?i)^PN_(.*)$", 1))

    def of(w: Column) -> Column:
        up = F.upper(w)
        pn = up.contains("_LPN") | up.contains("_VPN") | up.contains("_MPN")
        return F.when(up.startswith("ORN_"), F.regexp_extract(w, *forms[0])).when(up.endswith("_ORN"), F.regexp_extract(w, *forms[1])).when(pn, F.regexp_extract(w, *forms[2])).when(up.startswith("PN_"), F.regexp_extract(w, *forms[3]))

    return F.coalesce(F.get(F.filter(F.transform(_tokens(name), of), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def side_by_token(name: Column) -> Column:
    """The side in the first word that ends with one, then right or left as a word's beginning."""
    found = F.filter(F.transform(_tokens(F.upper(name)), lambda w: F.regexp_extract(w, "(?:^|[_-])([RL])$", 1)), lambda x: x != "")
    up = F.concat(F.lit(" "), F.upper(F.coalesce(name, F.lit(""))))
    return F.coalesce(F.get(found, F.lit(0)), F.when(up.contains(" RIGHT"), "R").when(up.contains(" LEFT"), "L").otherwise(""))
