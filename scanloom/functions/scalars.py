"""Column functions: blank-aware predicates, strings, hashes, guarded arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a true flag, and the distance that stands for an infinite one.
TRUE_WORDS = ("1", "true", "yes", "y")
HD95_PENALTY = 373.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- predicates ------------------------------------------------------------------


def boolish(c: Column | str) -> Column:
    """True for the accepted spellings of a flag; false for all else, null included."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def has_value(c: Column | str) -> Column:
    """Not null, not NaN in text or number, not blank."""
    text = F.trim(col(c).cast("string"))
    return F.coalesce((text != "") & (F.lower(text) != "nan"), F.lit(False))


def all_present(columns: Sequence[Column | str]) -> Column:
    return reduce(lambda a, b: a & b, [has_value(c) for c in columns], F.lit(True))


def usable(accepted: Column, allow_ablation: bool, ablation: Column) -> Column:
    """Accepted rows, and with the flag those that are for ablation only."""
    return F.coalesce(accepted, F.lit(False)) | (F.lit(allow_ablation) & F.coalesce(ablation, F.lit(False)))


def in_split(split: Column | str, name: str, aliases: Sequence[str] = ("inference", "predict", "test_only")) -> Column:
    """Rows of a split; for an inference alias every row."""
    if name.strip().lower() in aliases:
        return F.lit(True)
    return F.coalesce(F.lower(F.trim(col(split))) == name.strip().lower(), F.lit(False))


def first_text(*columns: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in columns))


# -- reasons and cases -----------------------------------------------------------


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """Names of the rules that hold, in order; a null condition doesn't hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in rules)))


def reason_text(found: Column, none: str = "pass") -> Column:
    return F.when(F.size(found) > 0, F.concat_ws(";", found)).otherwise(F.lit(none))


def blocking(found: Column, prefixes: Sequence[str] = (), suffixes: Sequence[str] = ("_warning",)) -> Column:
    """Reasons that aren't mere warnings."""

    def keep(r: Column) -> Column:
        tests = [~r.startswith(p) for p in prefixes] + [~r.endswith(s) for s in suffixes]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    return F.filter(found, keep)


def grade(reject: Column, review: Column, severe: Sequence[str], ablation: Column) -> Column:
    """F rejected, D severe review reasons, C for ablation only, A for training."""
    bad = F.arrays_overlap(review, F.array(*(F.lit(s) for s in severe)))
    return F.when(F.size(reject) > 0, "F").when(bad, "D").when(ablation | (F.size(review) > 0), "C").otherwise("A")


def volume_bucket(v: Column | str, low: float = 27, high: float = 275) -> Column:
    v = col(v)
    return F.when(v.isNull(), F.lit(None)).when(v < low, "tiny").when(v <= high, "small").otherwise("large")


def label_combination(flags: Mapping[str, Column]) -> Column:
    text = F.concat_ws("+", *(F.when(c, F.lit(name)) for name, c in flags.items()))
    return F.when(text == "", "none").otherwise(text)


def remap(c: Column | str, table: Mapping[int, int], other: Column | None = None) -> Column:
    """Values through a map; those that it lacks stay unless ``other`` is given."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(pairs, col(c)), col(c) if other is None else other)


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def regions(label: Column | str) -> dict[str, Column]:
    """Nested tumour regions of labels 1 core, 2 oedema, 3 enhancing."""
    c = col(label)
    return {"tc": c.isin(1, 3), "wt": c.isin(1, 2, 3), "et": c == 3}


# -- strings ---------------------------------------------------------------------

def case_parts(name: Column | str, cohort: str = "[A-Za-z]+-[A-Za-z]+") -> dict[str, Column]:
    """Cohort (a pattern), subject and visit of a case name; null where it isn't one."""
    c, pattern = col(name), rf"^({cohort})-(\d{{5}})-(\d{{3}})$"
    ok = F.coalesce(c.rlike(pattern), F.lit(False))
    return {k: F.when(ok, F.regexp_extract(c, pattern, i)) for i, k in ((1, "cohort"), (2, "subject"), (3, "visit"))}


def case_number(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"(\d{5}(?:-\d{3})?)", 1), F.lit(""))


def last_parts(c: Column | str, n: int, sep: str = "-") -> Column:
    parts = F.split(col(c), sep)
    return F.array_join(F.when(F.size(parts) <= n, parts).otherwise(F.slice(parts, -n, n)), sep)


def last_token(c: Column | str, sep: str = "-") -> Column:
    return F.element_at(F.split(col(c), sep), -1)


def stem(path: Column | str) -> Column:
    """File name up to its first dot."""
    return F.substring_index(F.element_at(F.split(col(path), "/"), -1), ".", 1)


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"/[^/]*$", "")


def posix(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def relative(path: Column | str, base: str) -> Column:
    base = base.rstrip("/") + "/"
    c = col(path)
    return F.when(c.startswith(base), F.substring(c, F.lit(len(base) + 1), F.length(c))).otherwise(c)


def part(c: Column | str, sep: str, i: int) -> Column:
    """Part ``i`` of a list written with ``sep``; empty where the list is too short."""
    return F.coalesce(F.get(F.split(col(c), sep), F.lit(i)), F.lit(""))


def padded(prefix: str, width: int, number: Column) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def formatted(c: Column | str, spec: str) -> Column:
    """A number by a format specification: its exact binary value rounded, halves to even. format_string rounds its shortest decimal, halves up."""

    def run(numbers: pa.Array) -> pa.Array:
        return pa.array([None if v is None else format(v, spec) for v in numbers.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(col(c).cast("double"))


def readable_bytes(n: Column | str, units: Sequence[str] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """A size in the first unit of which it has less than 1024, or else in the last."""
    c = col(n).cast("double")
    at = F.lit(len(units) - 1)
    for k in range(len(units) - 2, -1, -1):
        at = F.when(c < 1024.0 ** (k + 1), k).otherwise(at)
    return F.concat(formatted(c / F.pow(F.lit(2.0), 10 * at), ".1f"), F.lit(" "), F.get(F.array(*(F.lit(u) for u in units)), at))


# -- hashes ----------------------------------------------------------------------


def hash_score(c: Column | str, seed: int) -> Column:
    """A reproducible score in [0, 1): the first 64 bits of sha256('seed::id')."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}::"), col(c).cast("string")), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def record_id(record: Column, n: int = 12) -> Column:
    return F.substring(F.md5(F.to_json(record)), 1, n)


# -- arithmetic ------------------------------------------------------------------


def finite(c: Column | str) -> Column:
    """Null for NaN and the infinities."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null if either is missing or not finite, or b is 0."""
    return F.try_divide(finite(col(a).cast("double")), finite(col(b).cast("double")))


def guarded(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return guarded(2.0 * tp, 2 * tp + fp + fn)


def penalised_hd95(c: Column | str) -> Column:
    c = col(c)
    return F.when(c == float("inf"), F.lit(HD95_PENALTY)).otherwise(c)


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Place of the largest, from 0; the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def decode_regions(probabilities: Mapping[int, Column], bar: float = 0.5) -> Column:
    """The last class over the bar wins; 0 if none is."""
    out = F.lit(0)
    for label, p in probabilities.items():
        out = F.when(p > bar, F.lit(label)).otherwise(out)
    return out


def rescaled(x: Column, low: Column, high: Column) -> Column:
    """Clipped to [low, high] and scaled to [0, 1]; 0 if the range is empty."""
    return F.when(high > low, (F.least(F.greatest(x, low), high) - low) / (high - low)).otherwise(F.lit(0.0))


def short_number(c: Column | str, digits: int = 6) -> Column:
    """A number in at most ``digits`` significant digits, without trailing zeros; very small and large ones with an exponent of two digits or more."""
    return formatted(c, f".{digits}g")


def joined_numbers(c: Column, separator: str = ";", digits: int = 6) -> Column:
    """An array of numbers as text; nulls in it are left out."""

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else separator.join(f"{v:.{digits}g}" for v in r if v is not None) for r in rows.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(col(c).cast("array<double>"))


#: Powers of ten by prefix, metres by imperial unit.
PREFIXES = {"peta": 15, "tera": 12, "giga": 9, "mega": 6, "kilo": 3, "hecto": 2, "deca": 1, "": 0, "deci": -1, "centi": -2, "milli": -3, "micro": -6, "nano": -9, "pico": -12, "femto": -15}
IMPERIAL = {"inch": 0.0254, "foot": 0.3048, "yard": 0.9144, "mile": 1609.344}
QUANTITIES = ("meter", "byte", "bit")


def unit_factor(source: str, target: str) -> float:
    """What a number in the one unit is multiplied by to be in the other; an error where they don't measure the same."""

    def measured(unit: str) -> tuple[str, float]:
        unit = unit.lower()
        if unit in IMPERIAL:
            return "meter", IMPERIAL[unit]
        for base in QUANTITIES:
            if unit.endswith(base) and unit[: -len(base)] in PREFIXES:
                return base, 10.0 ** PREFIXES[unit[: -len(base)]]
        raise ValueError(f"unknown unit {unit}")

    (a, x), (b, y) = measured(source), measured(target)
    if a != b:
        raise ValueError(f"{source} is a {a}, {target} a {b}")
    return x / y
