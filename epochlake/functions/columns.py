"""Predicates, conditionals and scalar functions as Column expressions (groups P and F)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- projections, conditionals, predicates


def select_ordered(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """The preferred columns that exist first, the others after in their order."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def keep_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows where the predicate is true; a null counts as false."""
    return df.filter(F.coalesce(predicate, F.lit(False)))


def case_map(cases: Sequence[tuple[Column, object]], default=None) -> Column:
    """The value of the first true predicate."""
    out = None
    for predicate, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(predicate, value) if out is None else out.when(predicate, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def isin_table(df: DataFrame, dim: DataFrame, col: str, negate: bool = False) -> DataFrame:
    """Rows whose value is (not) in the dimension's column of the same name."""
    return df.join(dim.select(col).distinct(), col, "left_anti" if negate else "left_semi")


def combine_first(a: Column, b: Column) -> Column:
    """P5: a, or b where a is null."""
    return F.coalesce(a, b)


def safe_divide(a: Column, b: Column) -> Column:
    """A / b, null where b is null or 0."""
    return F.when(b != 0, a / b)


def to_int(c: Column) -> Column:
    """Integer value of a text, null if it is none."""
    return c.try_cast("bigint")


def to_double(c: Column) -> Column:
    """Number of a text, null if it is none."""
    return c.try_cast("double")


def bool_value(c: Column) -> Column:
    """True, 1, yes and y are true, false, 0, no and n false, all else null; case and spaces don't matter."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y", "1.0"), True).when(t.isin("false", "0", "no", "n", "0.0"), False)


def normalize_label(c: Column, mapping: Mapping[str, str]) -> Column:
    """One label for each text or number code, null if unknown; the mapping's keys are lower case."""
    t = F.lower(F.trim(c.cast("string")))
    return case_map([(t == k, v) for k, v in mapping.items()])


def assign_band(c: Column, bands: Sequence[tuple[str, float, float]]) -> Column:
    """P10: name of the first range, both ends included, that holds the value."""
    return case_map([(c.between(lo, hi), name) for name, lo, hi in bands])


def trial_to_block(trial: Column, size: int) -> Column:
    """Block number, from 1, of a running trial number from 1."""
    return (F.floor((trial - 1) / size) + 1).cast("bigint")


def block_trial_count(block: Column, trial: Column, size: int) -> Column:
    """Running number of a trial numbered inside its block."""
    return ((block - 1) * size + trial).cast("bigint")


def code_factor(c: Column, registry: Mapping[str, float]) -> Column:
    """Half-sum code of a level."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in registry.items() for x in kv]), c)


def status_fields(name: str, condition: Column, true_reason: tuple[str, str], false_reason: tuple[str, str]) -> list[Column]:
    """The flag (null is false), its status, reason code and reason text."""
    flag = F.coalesce(condition, F.lit(False))
    pick = lambda k: F.when(flag, true_reason[k]).otherwise(false_reason[k])
    return [flag.alias(name), F.when(flag, "pass").otherwise("fail").alias(f"{name}_status"), pick(0).alias(f"{name}_reason_code"), pick(1).alias(f"{name}_reason")]


def first_rule(rules: Sequence[tuple[Column, str, str, str]], default: tuple[str, str, str]) -> list[Column]:
    """Decision, code and reason of the first rule (predicate, decision, code, reason) that holds."""
    return [case_map([(r[0], r[k + 1]) for r in rules], default[k]).alias(n) for k, n in enumerate(("decision", "code", "reason"))]


def issue_codes(rules: Sequence[tuple[Column, str]]) -> Column:
    """Codes of all rules that hold, in the rules' order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(p, c) for p, c in rules])))


def incomplete_flag(end_gap: Column, size_ratio: Column, length_ratio: Column, shift: Column, *, max_gap: float, min_size: float, min_length: float, max_shift: float) -> Column:
    """A large end gap or small size, or a short path together with a lateral shift."""
    return F.coalesce((end_gap > max_gap) | (size_ratio < min_size) | ((length_ratio < min_length) & (shift > max_shift)), F.lit(False))


def gap_flag(time_step: Column, distance: Column, turn: Column, *, pause: float, levels: Sequence[tuple[float, float]]) -> Column:
    """A pause, or a jump beyond one of the levels (distance, turn)."""
    jump = F.lit(False)
    for d, a in levels:
        jump = jump | ((distance > d) & (F.abs(turn) > a))
    return F.coalesce((time_step > pause) | jump, F.lit(False))


def category_of(c: Column, sets: Mapping[str, Sequence], default: str = "regular") -> Column:
    """Name of the first id set that holds the value."""
    return case_map([(c.isin(list(v)), k) for k, v in sets.items()], default)


# ---- text


def parse_name(c: Column, pattern: str, names: Sequence[str]) -> list[Column]:
    """named groups of a pattern, and whether it matched."""
    got = [F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k + 1)).alias(n) for k, n in enumerate(names)]
    return [*got, F.when(c.rlike(pattern), "parsed").otherwise("unparsed").alias("parse_status")]


def find_all(c: Column, pattern: str, sep: str = ";") -> Column:
    """all matches, joined."""
    return F.array_join(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), sep)


def numeric_stem(c: Column) -> Column:
    """what is left without letters, dots and the like, as a number."""
    return F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")


def strip_ends(c: Column, a: int, b: int) -> Column:
    """without the first a and the last b characters."""
    return F.substr(c, F.lit(a + 1), F.greatest(F.length(c) - a - b, F.lit(0)))


def norm_name(c: Column) -> Column:
    """upper case without outer spaces."""
    return F.upper(F.trim(c))


def pad_id(c: Column, n: int) -> Column:
    """zero-padded to n characters; longer ids stay whole."""
    t = c.cast("string")
    return F.when(F.length(t) >= n, t).otherwise(F.lpad(t, n, "0"))


def has_token(c: Column, token: str) -> Column:
    """whether the token occurs, in any case."""
    return F.contains(F.lower(c), F.lit(token.lower()))


def classify_unit(unit: Column) -> Column:
    """F8: class of a physical unit: calibrated (volts of any scale), digital (none, counts) or unknown."""
    t = F.lower(F.trim(F.translate(F.coalesce(unit, F.lit("")), "µμ", "uu")))
    return F.when(t.isin("v", "mv", "uv", "nv"), "calibrated").when(t.isin("", "adc", "counts", "digital", "bits"), "digital").otherwise("unknown")


def file_role(c: Column) -> list[Column]:
    """single, split part (``_partN``) or concatenated (``_concat``), and the part's number."""
    part = F.regexp_extract(F.lower(c), r"[_-]part[_-]?([0-9]+)", 1)
    role = F.when(F.lower(c).rlike("[_-]concat"), "concatenated").when(part != "", "split_part").otherwise("single")
    return [role.alias("file_role"), F.when(part != "", part.cast("int")).alias("part_number")]


def digest_key(*cols: Column, version: str = "v1", length: int = 20) -> Column:
    """versioned key of a row: leading hex digits of the SHA-256 of its parts joined by ``|``; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(version), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256), 1, length)


# ---- dates and numbers


def first_date(c: Column) -> Column:
    """the first yyyy-MM-dd in a text."""
    return F.regexp_extract(c, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date")


def length_of(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def bezier_length(sx, sy, ex, ey, cx, cy) -> Column:
    """arc length of a quadratic Bezier curve in closed form; the chord where that is undefined (control on the chord)."""
    ax, ay = sx - 2 * cx + ex, sy - 2 * cy + ey
    bx, by = 2 * (cx - sx), 2 * (cy - sy)
    a, b, c = 4 * (ax * ax + ay * ay), 4 * (ax * bx + ay * by), bx * bx + by * by
    abc = 2 * F.sqrt(F.greatest(a + b + c, F.lit(0.0)))
    a2 = F.sqrt(a)
    a32, c2 = 2 * a * a2, 2 * F.sqrt(c)
    ba = safe_divide(b, a2)
    ratio = safe_divide(2 * a2 + ba + abc, ba + c2)
    full = safe_divide(a32 * abc + a2 * b * (abc - c2) + (4 * c * a - b * b) * F.ln(F.when(ratio > 0, ratio)), 4 * a32)
    return F.when(full.isNull() | F.isnan(full), length_of(sx, sy, ex, ey)).otherwise(full)


def bezier_point(t: Column, s: Column, e: Column, c: Column) -> Column:
    """one coordinate of the curve at t."""
    return (1 - t) * (1 - t) * s + 2 * (1 - t) * t * c + t * t * e


def bezier_points(df: DataFrame, n: int = 60, columns=("start_x", "start_y", "end_x", "end_y", "ctrl_x", "ctrl_y")) -> DataFrame:
    """n points per segment row at t = 0, 1/n ... (n-1)/n, as ``point_index``, ``t``, ``x``, ``y``; the end is the next segment's start."""
    sx, sy, ex, ey, cx, cy = (F.col(c) for c in columns)
    steps = df.withColumn("point_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.col("point_index") / F.lit(float(n)))
    return steps.withColumns({"x": bezier_point(F.col("t"), sx, ex, cx), "y": bezier_point(F.col("t"), sy, ey, cy)})


def bezier_curvature(t: Column, sx, sy, ex, ey, cx, cy, ieee: bool = False) -> Column:
    """signed curvature at t, null where the speed is 0 (NaN or infinite, as IEEE divides, if ``ieee``)."""
    dx, dy = 2 * (1 - t) * (cx - sx) + 2 * t * (ex - cx), 2 * (1 - t) * (cy - sy) + 2 * t * (ey - cy)
    ddx, ddy = 2 * (ex - 2 * cx + sx), 2 * (ey - 2 * cy + sy)
    turn, speed = dx * ddy - dy * ddx, F.pow(dx * dx + dy * dy, F.lit(1.5))
    by_zero = F.when(turn == 0, F.lit(float("nan"))).otherwise(turn * F.lit(float("inf")))
    return F.when(speed == 0, by_zero).otherwise(turn / speed) if ieee else safe_divide(turn, speed)


def sinuosity(curve: Column, chord: Column) -> Column:
    """F16: curve length over chord length."""
    return safe_divide(curve, chord)


def to_db(p: Column, b: Column) -> Column:
    """10 log10(p / b); null unless both are positive."""
    return F.when((p > 0) & (b > 0), 10 * F.log10(p / b))


def log_power(p: Column) -> Column:
    """log10 of a positive power, else null."""
    return F.when(p > 0, F.log10(p))


def sphere_to_latlon(x: Column, y: Column, z: Column) -> list[Column]:
    """latitude and longitude in degrees of a point seen from the origin."""
    r = F.sqrt(x * x + y * y + z * z)
    return [F.degrees(F.asin(safe_divide(z, r))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon")]


def mirror(x: Column, hand: Column) -> Column:
    """left and right swapped for left-handed rows."""
    return F.when(hand == "left", -x).otherwise(x)


def tidy_coord(lat: Column, lon: Column, digits: int = 1) -> list[Column]:
    """rounded; the longitude of a pole is 0."""
    la = F.round(lat, digits) + 0.0
    return [la.alias("lat"), F.when(F.abs(la) >= 90, F.lit(0.0)).otherwise(F.round(lon, digits)).alias("lon")]


def scale_range(df: DataFrame, col: str, span: tuple[float, float] = (0.0, 1.0), out: str = "scaled") -> DataFrame:
    """linear scale of the column's range to the span; its middle if all values are equal."""
    ends = F.broadcast(df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi")))
    lo, hi = span
    value = F.when(F.col("__hi") > F.col("__lo"), lo + (F.col(col) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (hi - lo)).when(F.col(col).isNotNull(), (lo + hi) / 2)
    return df.crossJoin(ends).withColumn(out, value).drop("__lo", "__hi")


def unit_disk(df: DataFrame, x: str, y: str, eps: float = 1e-6) -> DataFrame:
    """scale by the largest radius so that all points lie inside the unit disk (the outermost at 1 - eps)."""
    top = F.broadcast(df.agg(F.max(F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))).alias("__r")))
    return df.crossJoin(top).withColumns({f"{v}_unit": safe_divide(F.col(v), F.col("__r")) * (1 - eps) for v in (x, y)}).drop("__r")


def extreme(z: Column, c: float) -> Column:
    """two-sided tail test of a z value."""
    return F.abs(z) > c


def to_sample(seconds: Column, fs: float) -> Column:
    """nearest sample; a value half way between two samples is an error."""
    s = seconds * fs
    tie = F.abs(F.abs(s - F.floor(s)) - 0.5) < 1e-9
    return F.when(tie, F.raise_error(F.concat(F.lit("half-sample tie at "), s.cast("string"))).cast("bigint")).otherwise(F.rint(s).cast("bigint"))


def n_samples(a: Column, b: Column, fs: float) -> Column:
    """samples from a to b seconds, both included."""
    return to_sample(b, fs) - to_sample(a, fs) + 1


def mask_code(c: Column, mask: int) -> Column:
    """the bits of an integer that the mask keeps."""
    return c.cast("bigint").bitwiseAND(F.lit(mask).cast("bigint"))


def rel_change(a: Column, b: Column) -> Column:
    """(a - b) / b, null where b is null or 0."""
    return safe_divide(a - b, b)


def mixture_label(x: Column, mean0: float, sd0: float, mean1: float, sd1: float, logit: float) -> Column:
    """log odds of class 1 against class 0 for two normal classes and a prior log odds."""
    log = lambda m, s: -F.ln(F.lit(s)) - (x - m) * (x - m) / (2 * s * s)
    return F.lit(logit) + log(mean1, sd1) - log(mean0, sd0)


def unscale(c: Column, mean: Column, sd: Column) -> Column:
    """undo a z-score."""
    return c * sd + mean


# ---- arrays, JSON and code lists


def slice_by(arr: Column, lo: int, hi: int) -> Column:
    """elements lo to hi, counted from 0, both included."""
    return F.slice(arr, lo + 1, hi - lo + 1)


def array_mean(arr: Column) -> Column:
    return safe_divide(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), F.size(arr))


def array_span_mean(arr: Column, lo: int, hi: int) -> Column:
    """mean of elements lo to hi."""
    return array_mean(slice_by(arr, lo, hi))


def ptp(arr: Column) -> Column:
    """peak to peak."""
    return F.array_max(arr) - F.array_min(arr)


def max_step(arr: Column) -> Column:
    """largest absolute difference of neighbours; null for fewer than two."""
    n = F.size(arr)
    return F.when(n > 1, F.array_max(F.zip_with(F.slice(arr, F.lit(1), n - 1), F.slice(arr, F.lit(2), n - 1), lambda a, b: F.abs(b - a))))


def repeat_rows(df: DataFrame, n: int, index: str = "copy") -> DataFrame:
    """each row n times, numbered from 0."""
    return df.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def parse_tuples(c: Column) -> Column:
    """text such as ``[(1, 2.5), (3, 4)]`` as an array of arrays of numbers; null if it is none."""
    return F.from_json(F.translate(c, "()", "[]"), "array<array<double>>")


def json_element(c: Column, role: str, fields: str) -> Column:
    """F32: the one object with this ``role`` in a JSON list; null if there is none or more than one."""
    found = F.filter(F.from_json(c, f"array<struct<role string, {fields}>>"), lambda x: x["role"] == role)
    return F.when(F.size(found) == 1, found[0])


def count_json(names: Column) -> Column:
    """how often each text occurs in an array, as JSON with sorted keys."""
    kinds = F.array_sort(F.array_distinct(names))
    return F.to_json(F.map_from_entries(F.transform(kinds, lambda k: F.struct(k.alias("key"), F.size(F.filter(names, lambda x: x == k)).alias("value")))))


def split_codes(c: Column, sep: str = ";") -> Column:
    """codes of a list in a text, without blanks; null and empty give none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def has_code(c: Column, code: str, sep: str = ";") -> Column:
    """whether a list in a text holds the code."""
    return F.array_contains(split_codes(c, sep), code)


def code_candidate(c: Column, mapping: Mapping[int, int]) -> list[Column]:
    """the code that a raw code may stand for, and the rule; the raw code itself is left alone."""
    target = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c)
    return [F.coalesce(target, c).alias("candidate_code"), F.when(target.isNotNull(), "mapped").otherwise("identity").alias("candidate_rule")]


def next_label(c: Column, order: Sequence[str]) -> Column:
    """the label that follows in a cyclic order."""
    return F.element_at(F.create_map(*[F.lit(x) for a, b in zip(order, [*order[1:], order[0]]) for x in (a, b)]), c)
