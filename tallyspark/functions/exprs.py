"""Column expressions: every rule here stays inside whole-stage code generation."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _plain(code: int) -> str:
    """The ASCII part of a character's compatibility decomposition."""
    return unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()


#: Letters that decompose into one ASCII character, of the basic plane, and those characters, in the same order.
ACCENTED = "".join(chr(c) for c in range(0x80, 0x10000) if len(_plain(c)) == 1)
PLAIN = "".join(_plain(ord(c)) for c in ACCENTED)
#: Latin letters that decompose into several: ligatures and digraphs.
LIGATURES = {chr(c): _plain(c) for c in (*range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB07)) if len(_plain(c)) > 1}
#: Generational suffixes that are no part of a name.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def safe_div(a: Column, b: Column) -> Column:
    """a / b; null for a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def sum_if(condition: Column, x: Column) -> Column:
    """Sum of x where the condition holds; 0 when nothing does."""
    return F.coalesce(F.sum(F.when(condition, x)), F.lit(0))


def avg_if(condition: Column, x: Column) -> Column:
    return F.avg(F.when(condition, x))


def clip(x: Column, low: float | None = None, high: float | Column | None = None) -> Column:
    """x within its bounds; null stays null (greatest and least would skip it)."""
    out = x
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    return F.when(x.isNotNull(), out)


def margin_label(margin: Column) -> Column:
    """1 for a positive margin, 0 for a negative one, null for a push or an unknown one."""
    return F.when(margin > 0, 1).when(margin < 0, 0)


def cover_label(margin: Column, line: Column) -> Column:
    """Who covers a line (negative where the home side is the favourite): the favourite or the underdog, whichever side plays at home;
    null on a push, without a favourite, or where either is unknown."""
    beat = margin + line
    home = F.when(beat > 0, F.when(line < 0, "favourite").when(line > 0, "underdog"))
    return F.when(beat < 0, F.when(line < 0, "underdog").when(line > 0, "favourite")).otherwise(home)


def opponent_adjusted(pairs: list[tuple[str, str]], ratios: list[tuple[str, str, str, str, str]], sides: tuple[str, str] = ("home_", "away_")) -> dict[str, Column]:
    """Own value less what the other side allows, by name, for both sides.

    pairs: (own, allowed). ratios: (name, own numerator and denominator, allowed ones); a rate without attempts counts as 0.
    """
    out = {}
    for side, other in (sides, sides[::-1]):
        out |= {f"{side}adjusted_{own}": F.col(side + own) - F.col(other + allowed) for own, allowed in pairs}
        for name, a, b, c, d in ratios:
            own, allowed = (F.coalesce(safe_div(F.col(s + x), F.col(s + y)), F.lit(0.0)) for s, x, y in ((side, a, b), (other, c, d)))
            out[f"{side}adjusted_{name}"] = own - allowed
    return out


def is_success(down: Column, distance: Column, gained: Column) -> Column:
    """First downs need half of the distance, second downs 70 %, later ones all of it; no valid distance is no success."""
    need = F.when(down == 1, 0.5).when(down == 2, 0.7).when(down.isin(3, 4), 1.0)
    return F.coalesce((distance > 0) & (gained >= need * distance), F.lit(False))


def compound_part(text: Column, part: int, sep: str = "-") -> Column:
    """The part-th number of "X-Y", from 1; null if it is none."""
    return F.split_part(text, F.lit(sep), F.lit(part)).try_cast("int")


def clock_minutes(text: Column) -> Column:
    """"MM:SS" as minutes; anything else is null."""
    pattern = r"^(\d+):(\d+)$"
    minutes = F.regexp_extract(text, pattern, 1).try_cast("double")
    return minutes + F.regexp_extract(text, pattern, 2).try_cast("double") / 60


def pythagorean(scored: Column, allowed: Column, k: float | Column = 2.0, eps: float = 0.0) -> Column:
    """scored^k / (scored^k + allowed^k + eps); null when all are zero."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    a, b = F.pow(scored.cast("double"), k), F.pow(allowed.cast("double"), k)
    return safe_div(a, a + b + F.lit(float(eps)))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function; Abramowitz and Stegun 7.1.26, error below 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def elo_probability(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / 400))


def normalize_name(name: Column) -> Column:
    """Accents and what has no plain letter off, dots and apostrophes out, single blanks, lower case, no generational suffix; null becomes ''."""
    plain = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), LIGATURES.items(), F.coalesce(name, F.lit("")))
    plain = F.regexp_replace(F.translate(plain, ACCENTED, PLAIN), r"[^\x00-\x7F]|[.']", "")
    tokens = F.split(F.trim(F.lower(plain)), r"\s+")
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(*NAME_SUFFIXES, "")), " ")


def json_ids(text: Column) -> Column:
    """A JSON list of ids as an array, without null, empty and "0" entries."""
    return F.filter(F.from_json(text, "array<string>"), lambda x: x.isNotNull() & ~x.isin("", "0"))


def camel_to_snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def expand_names(stats: list[str], sides: tuple[str, ...] = ("home_", "away_"), transforms: tuple[str, ...] = ("prev_week_{}", "{}_avg_all", "{}_avg3")) -> list[str]:
    """Column names of every statistic, side and transform."""
    return [side + t.format(stat) for stat in stats for side in sides for t in transforms]


def parse_name(name: str) -> tuple[str, str, str]:
    """(side, transform, statistic) of a column name."""
    side = next((s for s in ("home", "away", "diff") if name.startswith(s + "_")), "")
    rest = name[len(side) + 1 :] if side else name
    for prefix, transform in (("prev_week_", "prev_week"), ("trend_", "trend")):
        if rest.startswith(prefix):
            return side, transform, rest[len(prefix) :]
    for suffix in ("avg_all", "avg3"):
        if rest.endswith("_" + suffix):
            return side, suffix, rest[: -len(suffix) - 1]
    return side, "", rest


def transform_groups(names: list[str]) -> dict[tuple[str, str], dict[str, str]]:
    """(side, statistic) -> transform -> column name, of the columns that are one statistic by some transform."""
    out: dict[tuple[str, str], dict[str, str]] = {}
    for name in names:
        side, transform, stat = parse_name(name)
        if transform:
            out.setdefault((side, stat), {})[transform] = name
    return out


def mirror_pairs(names: list[str], own: str = "offense", other: str = "defense") -> list[tuple[str, str]]:
    """Columns that differ only in which side of the ball they name, the own one first."""
    known = set(names)
    return [(n, m) for n in names if own in n and (m := n.replace(own, other)) in known]


def domain_of(name: str, domains: dict[str, tuple[str, ...]], default: str = "other") -> str:
    """The first domain one of whose marks is in the column's statistic."""
    stat = parse_name(name)[2]
    return next((d for d, marks in domains.items() if any(m in stat for m in marks)), default)
