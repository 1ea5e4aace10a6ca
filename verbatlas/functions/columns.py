"""Column expressions of the domain: tags, lemmas, ages, strata, labels and bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..schemas import number

Name = Column | str


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_pos(c: Name) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))), F.lit(""))


def norm_rel(c: Name) -> Column:
    """One spelling of relations: lower case, with colons for hyphens and underscores."""
    return F.coalesce(F.translate(F.lower(F.trim(col(c))), "_-", "::"), F.lit(""))


def lemma(stem: Name, gloss: Name) -> Column:
    return F.coalesce(F.lower(F.trim(F.coalesce(F.when(F.trim(col(stem)) != "", col(stem)), col(gloss)))), F.lit(""))


def is_nonword(gloss: Name) -> Column:
    g = F.coalesce(F.lower(F.trim(col(gloss))), F.lit(""))
    return g.isin(*lx.NONWORDS) | g.startswith("&")


def age_in_months(c: Name) -> Column:
    """Over 120 an age is taken for days."""
    a = number(c)
    return F.when(a > lx.DAYS_FROM, a / F.lit(lx.DAYS_PER_MONTH)).otherwise(a)


def age_bin(c: Name, width: float = lx.BIN_MONTHS) -> Column:
    b = F.floor((col(c) - lx.AGE_MIN) / width) * width + lx.AGE_MIN
    return F.least(F.greatest(b, F.lit(lx.AGE_MIN)), F.lit(lx.AGE_MAX - width)).cast("int")


def bins(width: float = lx.BIN_MONTHS) -> list[int]:
    n = int(-(-(lx.AGE_MAX - lx.AGE_MIN) // width))
    return [int(lx.AGE_MIN + k * width) for k in range(n)]


def is_child(role: Name) -> Column:
    return F.coalesce(col(role).isin(*lx.CHILD_ROLES), F.lit(False))


def is_parent(role: Name) -> Column:
    return F.coalesce(col(role).isin(*lx.PARENT_ROLES), F.lit(False))


def strata(role: Name, age: Name) -> Column:
    """All strata of a speaker at an age in months; the narrowest first."""
    r, a = F.trim(col(role)), col(age)
    child, parent = r.isin(*lx.CHILD_ROLES), r.isin(*lx.PARENT_ROLES)
    cases = [
        ("Child I", child & (a >= lx.CHILD_I[0]) & (a < lx.CHILD_I[1])),
        ("Child II", child & (a >= lx.CHILD_II[0]) & (a < lx.CHILD_II[1])),
        ("Parent Young", parent & (a < lx.PARENT_YOUNG_MAX)),
        ("Parent All", parent & (a < lx.PARENT_ALL_MAX)),
    ]
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in cases]))


def narrowest_stratum(role: Name, age: Name) -> Column:
    return F.get(strata(role, age), F.lit(0))


def in_study(corpus: Name) -> Column:
    names = {n.lower() for n in (*lx.STUDY_CORPORA, *lx.CORPUS_ALIASES)}
    return F.coalesce(F.lower(col(corpus)).isin(*sorted(names)), F.lit(False))


def path_matches(filename: Name, patterns: tuple[str, ...]) -> Column:
    """Whether a path has one of the patterns anywhere in it, whatever the case and the slashes."""
    path = F.lower(F.translate(F.coalesce(col(filename), F.lit("")), "\\", "/"))
    parts = [p.replace("\\", "/").lower().rstrip("/") for p in patterns]
    return reduce(lambda a, b: a | b, [path.contains(p) for p in parts], F.lit(False))


def excluded_file(filename: Name, stratum: str) -> Column:
    """Files left out of ``child``, ``parent_young`` or ``parent_all``, each list adding to the one before."""
    patterns = lx.EXCLUDED_FILES
    if stratum in ("parent_young", "parent_all"):
        patterns += lx.EXCLUDED_PARENT_FILES
    if stratum == "parent_all":
        patterns += lx.EXCLUDED_PARENT_ALL_FILES
    return path_matches(filename, patterns)


def has_preposition(prep: Name) -> Column:
    return F.coalesce(F.trim(col(prep)) != "", F.lit(False))


def construction_key(construction: Name, prep: Name) -> Column:
    """VL-to, or the construction where it takes no preposition; the preposition as it stands."""
    c, p = col(construction), col(prep)
    return F.when(c.isin(*lx.LOCATIVE) & F.coalesce(p != "", F.lit(False)), F.concat(c, F.lit("-"), p)).otherwise(c)


def item_key(construction: Name, prep: Name, verb: Name) -> Column:
    return F.concat(construction_key(construction, F.lower(col(prep))), F.lit("|"), F.lower(col(verb)))


def is_schematic(construction: Name, extra: Name | None = None) -> Column:
    ok = col(construction).isin(*lx.SCHEMATIC)
    return ok if extra is None else ok & ~F.coalesce(col(extra), F.lit(False))


def prepositions(construction: str, stratum: str | None = None) -> tuple[str, ...]:
    own = {"VL": lx.PREPS_BOTH + lx.PREPS_VL, "VOL": lx.PREPS_BOTH + lx.PREPS_VOL}.get(construction, ())
    return tuple(p for p in own if stratum not in ("Child I", "Parent Young") or p not in lx.PREPS_LATE)


def counted_in(stratum: Name, prep: Name) -> Column:
    """The young strata do not count late prepositions."""
    late = F.coalesce(F.lower(col(prep)).isin(*lx.PREPS_LATE), F.lit(False))
    return ~(F.coalesce(col(stratum).isin("Child I", "Parent Young"), F.lit(False)) & late)


def min_children(vac: Name, given: int | None = None) -> Column:
    if given is not None:
        return F.lit(given)
    return F.when(col(vac).startswith("VOO"), F.lit(lx.MIN_CHILDREN_VOO)).otherwise(F.lit(lx.MIN_CHILDREN))


def finite(c: Name, digits: int | None = None) -> Column:
    x = F.when(~F.isnan(col(c)) & (F.abs(col(c)) < float("inf")), col(c))
    return x if digits is None else F.round(x, digits)
