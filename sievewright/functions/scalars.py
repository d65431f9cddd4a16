"""Column expressions: hashes of vectors, distances, tags, encodings and parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sign_hash(vector: Column) -> Column:
    """64-bit hash: one bit a coefficient, set where it exceeds the median, first coefficient highest."""

    def of(v: Column) -> Column:
        n = F.size(v)
        ordered = F.sort_array(v)
        middle = (F.element_at(ordered, F.ceil((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))) / 2
        return let(middle, lambda m: F.aggregate(v, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > m, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))))

    return let(vector.cast("array<double>"), of)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column, floor: float = 1e-12) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(floor))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (l2_norm(a) * l2_norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """A vector of length one; its norm is computed once."""
    return let(l2_norm(a), lambda n: F.transform(a, lambda x: x / n))


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Spherical interpolation between two vectors; every step is computed once, so the work is that of a few products."""

    def turned(u: Column) -> Column:
        return let(F.least(F.greatest(dot(u["a"], u["b"]), F.lit(-1.0)), F.lit(1.0)), lambda c: along(u, c))

    def along(u: Column, c: Column) -> Column:
        side = unit(F.zip_with(u["b"], u["a"], lambda y, x: y - c * x))
        angle = t * F.acos(c)
        return let(side, lambda s: unit(F.zip_with(u["a"], s, lambda x, y: x * F.cos(angle) + y * F.sin(angle))))

    return let(F.struct(unit(a).alias("a"), unit(b).alias("b")), turned)


def half_even(value: Column) -> Column:
    """Integer quota, halves to even."""
    return F.bround(value.cast("double"), 0).cast("long")


def preserved(path: Column, root: str, to: str, suffix: str) -> Column:
    """The path below ``root`` moved below ``to`` with another suffix; folders stay."""
    below = portable(path, root)
    return F.concat(F.lit(to.rstrip("/") + "/"), F.regexp_replace(below, r"\.[^./]*$", ""), F.lit(suffix))


def ratio_tag(value: Column, prefix: str = "r") -> Column:
    """1.0 gives r1, 2.5 gives r2.5."""
    return F.concat(F.lit(prefix), F.regexp_replace(value.cast("string"), r"\.0$", ""))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, 1).otherwise(0))


def numeric_or_null(value: Column) -> Column:
    return value.try_cast("double")


def significance_stars(p: Column) -> Column:
    return F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("ns")


def integer_list(spec: Column) -> Column:
    """``1,2,5-7`` as an array of integers."""
    parts = F.split(spec, ",")
    spans = F.transform(parts, lambda p: F.sequence(F.split(p, "-").getItem(0).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))
    return F.flatten(spans)


def pair_of(spec: Column, mark: str = "x") -> Column:
    """``MxN`` as a struct of two integers."""
    pattern = rf"^(\d+){mark}(\d+)$"
    return F.struct(F.regexp_extract(spec, pattern, 1).cast("int").alias("first"), F.regexp_extract(spec, pattern, 2).cast("int").alias("second"))


def brief_duration(seconds: Column) -> Column:
    """``1d 02h``, ``2h 03m`` or ``4m 05s``."""
    s = seconds.cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
        .when(s < 86400, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s / 60) % 60))
        .otherwise(F.format_string("%dd %02dh", F.floor(s / 86400), F.floor(s / 3600) % 24))
    )


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def token_in(stem: Column, allowed: list[str]) -> Column:
    """The first ``_``-separated token among ``allowed``, in its own case, else one that stands between underscores; null if none."""
    exact = F.get(F.filter(F.split(stem, "_"), lambda t: t.isin(allowed)), 0)
    inside = F.coalesce(*[F.when(F.contains(stem, F.lit(f"_{a}_")), F.lit(a)) for a in allowed])
    return F.coalesce(exact, inside)


#: Class codes of test file names, and the planes.
CLASS_CODES = {"gl": "glioma", "me": "meningioma", "no": "no_tumor", "nt": "no_tumor", "pi": "pituitary"}
PLANES = ["ax", "co", "sa"]


def test_name(stem: Column, check_plane: bool = True) -> Column:
    """(class, plane) from the fourth and fifth of six or more ``_``-separated tokens; a plane that is none is null if checked."""
    tokens = F.split(stem, "_")
    enough = F.size(tokens) >= 6
    code, plane = F.get(tokens, F.lit(3)), F.get(tokens, F.lit(4))
    names = F.create_map(*[F.lit(x) for pair in CLASS_CODES.items() for x in pair])
    plane = F.when(plane.isin(PLANES), plane) if check_plane else plane
    return F.struct(F.when(enough, F.try_element_at(names, code)).alias("class"), F.when(enough, plane).alias("plane"))


test_name.__test__ = False


def content_hash(*parts: Column) -> Column:
    """sha256 of shape, type and bytes, kept apart by zero bytes."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def hash_rank(seed: int, *ids: Column) -> Column:
    """A seeded integer mixing of ids that DuckDB computes alike: two rounds of a 31-bit generator."""
    x = F.lit(seed).cast("long")
    for i in ids:
        x = ((x * 48271 + i.cast("long") * 69621 + 12345) % 2147483647 + 2147483647) % 2147483647
        x = (x * 48271 + 11) % 2147483647
    return x


#: Factor of ``mix32`` and the mask of its words.
MIX, WORD = 73244475, 0xFFFFFFFF


def mix32(seed: Column | int, *ids: Column) -> Column:
    """32 mixed bits of a seed and ids, alike in DuckDB and NumPy: each word is folded in, shifted onto itself and multiplied.

    Unlike ``hash_rank`` it is not linear in the ids, so draws by consecutive numbers are independent.
    """
    words = [w for i in ids for w in (i.cast("long").bitwiseAND(F.lit(WORD)), F.shiftright(i.cast("long"), 32).bitwiseAND(F.lit(WORD)), F.lit(0).cast("long"))]
    start = (F.lit(seed) if isinstance(seed, int) else seed).cast("long").bitwiseAND(F.lit(WORD))

    def fold(x: Column, i: Column) -> Column:
        m = x.bitwiseXOR(i)
        return (m.bitwiseXOR(F.shiftright(m, 16)) * MIX).bitwiseAND(F.lit(WORD))

    return F.aggregate(F.array(*words, F.lit(0).cast("long")), start, fold)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a rate."""
    p = k / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)


def portable(path: Column, root: str) -> Column:
    """A path relative to a root that it lies in, else as it is."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(top)), F.substring(path, F.lit(len(top) + 1), F.length(path))).otherwise(path)


def sorted_struct(**fields: Column) -> Column:
    """A struct of named columns in order of their names, as compact JSON with sorted keys needs it."""
    return F.struct(*[fields[n].alias(n) for n in sorted(fields)])
