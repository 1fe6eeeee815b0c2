"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bins, a power of two, and the low-order bits stored of each.
BINS, BITS = 256, 4
SHINGLE_WORDS = 5
#: An empty bin makes so many probes one by one; then it looks at these ranges of probes, each at once.
PROBES, LOOKS = 12, (12, 48, BINS)
#: Text that a key range should hold, and the least and most ranges; beyond 25 TB the ranges grow.
RANGE_BYTES, RANGES = 1 << 28, (256, 100_000)
_LANES = 64 // BITS


def shingle_hashes(text: Column) -> Column:
    """Hashes of the 5-word shingles; with fewer words, of the whole sequence; none without words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(words: Column) -> Column:
    """Shingles from hashed words, as bin * 2**32 + hash. ``words`` must be a plain column, so that it is made once."""
    n, bits = F.size(words), F.lit((BINS << 32) - 1)

    def shingle(i: Column) -> Column:  # as the hash of the array of its words, without making that array
        return F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE_WORDS)]).bitwiseAND(bits)

    some = F.transform(F.sequence(F.lit(0), n - SHINGLE_WORDS), shingle)
    whole = F.array(F.xxhash64(words).bitwiseAND(bits))
    return F.when(n >= SHINGLE_WORDS, some).when(n > 0, whole).otherwise(F.array_repeat(F.lit(0).cast("long"), 0))


def _sorted(shingles: Column) -> Column:
    """Twice the shingles in order, and behind those of each bin an odd mark. Nothing in it can be null, so the sort is one of plain numbers."""
    marks = F.sequence(F.lit((1 << 33) - 1), F.lit((BINS << 33) - 1), F.lit(1 << 33))
    return F.sort_array(F.concat(F.transform(shingles, lambda v: F.shiftleft(v, 1)), marks))


def _firsts(placed: Column) -> Column:
    """What is first in each bin: twice its smallest shingle, or the mark of an empty one. ``placed`` must be a plain column, from ``_sorted``."""
    # the first entry of each bin stands behind the mark of the bin before
    return F.filter(placed, lambda v, i: (i == 0) | (F.get(placed, i - 1).bitwiseAND(F.lit((1 << 33) - 1)) == (1 << 33) - 1))


def _values(firsts: Column) -> Column:
    """The smallest hash of every bin, null in empty bins."""
    return F.transform(firsts, lambda v: F.when(v.bitwiseAND(F.lit(1)) == 0, F.shiftright(v, 1).bitwiseAND(F.lit((1 << 32) - 1))))


def _orders(spark: SparkSession) -> tuple[Column, Column]:
    """Start and odd step of each bin's probes, hashes of the bin, as two literals."""
    bin_ = F.col("id").cast("int")
    rows = spark.range(BINS).select("id", F.pmod(F.hash(bin_), F.lit(BINS)).alias("start"), (F.pmod(F.hash(bin_, F.lit(1)), F.lit(BINS // 2)) * 2 + 1).alias("step"))
    rows = sorted(rows.collect())  # one per bin
    return _longs([r.start for r in rows]), _longs([r.step for r in rows])


def _dense(values: Column, starts: Column, steps: Column) -> Column:
    """Low-order bits of all bins. ``values`` must be a plain column with a value in one bin at least.

    An empty bin probes others in an order of its own, the same for all documents, until it meets one that
    has a value: a full cycle with a start and an odd step that hashes of the bin give. The value is hashed
    with the bin before its low bits are taken, so that few values spread over many bins agree by chance as rarely as others.
    """
    low = F.lit((1 << BITS) - 1)

    def probe(i: Column, t: Column) -> Column:
        return F.get(values, (F.get(starts, i) + t * F.get(steps, i)).bitwiseAND(F.lit(BINS - 1)).cast("int"))

    def look(i: Column, first: int, last: int) -> Column:
        return F.get(F.filter(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda t: probe(i, t)), lambda v: v.isNotNull()), F.lit(0))

    def lent(i: Column) -> Column:
        # a later probe is only made if those before it met empty bins
        single = [probe(i, F.lit(t)) for t in range(PROBES)]
        return F.xxhash64(F.coalesce(*single, *[look(i, a, b - 1) for a, b in zip(LOOKS, LOOKS[1:])]), i)

    return F.transform(values, lambda v, i: F.coalesce(v, lent(i)).bitwiseAND(low))


def _packed(dense: Column) -> Column:
    """Low-order bits as an array of long, the bins one behind the other from the high bits on."""

    def lane(k: Column) -> Column:
        own = F.slice(dense, k * _LANES + 1, _LANES)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(v))

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // _LANES - 1)), lane)


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: an array of long with BITS bits per bin, empty for null texts and texts without words.

    Equal texts get equal fingerprints. The steps are columns of their own, so each is worked out once per
    row, inside the row; nothing is shuffled. A column ``_<name>`` must not exist.
    """
    step = f"_{name}"
    rows = rows.withColumn(step, shingle_hashes(F.col(text)))
    rows = rows.withColumn(step, _shingles(F.col(step)))
    rows = rows.withColumn(step, F.when(F.size(step) > 0, _sorted(F.col(step))))
    rows = rows.withColumn(step, F.when(F.col(step).isNotNull(), _firsts(F.col(step))))
    rows = rows.withColumn(step, F.when(F.col(step).isNotNull(), _values(F.col(step))))
    rows = rows.withColumn(step, F.when(F.col(step).isNotNull(), _dense(F.col(step), *_orders(rows.sparkSession))))
    packed = F.when(F.col(step).isNotNull(), _packed(F.col(step))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn(name, packed).drop(step)


def as_hex(fingerprint: Column) -> Column:
    return F.concat_ws("", F.transform(fingerprint, lambda v: F.lpad(F.hex(v), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, from 0 to 1.

    Bins of unlike sets agree by chance with probability 2**-BITS, which is taken out. Two texts without words are alike.
    """
    low_bits = sum(1 << (BITS * k) for k in range(_LANES))
    chance = 2.0**-BITS

    def unlike(x: Column, y: Column) -> Column:
        both = x.bitwiseXOR(y)
        any_bit = both
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(both, k))
        return F.bit_count(any_bit.bitwiseAND(F.lit(low_bits)))

    n = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda s, v: s + v)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((1 - n / BINS) - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(near)


def _longs(values: list[int]) -> Column:
    """An array of constants, as one literal however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bucket(order: Column, bounds: list[int]) -> Column:
    """Number of the sorted ``bounds`` that are ``order`` or less, by halving steps."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    known = _longs(bounds)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= order, at + step).otherwise(at))


def n_ranges(size: int) -> int:
    """Ranges for ``size`` bytes: one per ``RANGE_BYTES``, within ``RANGES``."""
    return min(max(RANGES[0], -(-size // RANGE_BYTES)), RANGES[1])


def with_next(rows: DataFrame, key: str, tie: str, columns: list[str], ranges: int = 256) -> DataFrame:
    """Adds ``next_<c>`` for ``columns``: the values of the next row by descending ``key``; the first row follows the last.

    Rows are dealt to ``ranges`` key ranges of about equal size by their quantiles; the head of each range is also sent to the range
    before it, so one shuffle and a window per range do. A null key comes last; rows with equal keys are in one range,
    ordered by ``tie``, equal ones of those anyhow. What the driver holds and tasks are sent is four numbers per range.
    """
    lowest = -(2**63)
    order = F.coalesce(F.col(key), F.lit(lowest))
    quantiles = rows.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], max(10_000, 40 * ranges))).first()[0] or []
    rows = rows.withColumn("_bucket", _bucket(order, sorted(set(quantiles))))
    heads = rows.groupBy("_bucket").agg(F.max(F.struct(order.alias("key"), F.col(tie).alias("tie"))).alias("head")).collect()  # one per range
    heads = sorted((h._bucket, h.head.key, h.head.tie) for h in heads)
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"))
    sent = F.array(own)
    if heads:
        last = heads[-1][0] + 1
        head_key, head_tie, to = [lowest] * last, [0] * last, [0] * last
        for (b, k, t), (before, _, _) in zip(heads, heads[1:] + heads[:1]):
            head_key[b], head_tie[b], to[b] = k, t, before
        is_head = (order == F.get(_longs(head_key), F.col("_bucket"))) & (F.col(tie) == F.get(_longs(head_tie), F.col("_bucket")))
        guest = F.struct(F.get(_longs(to), F.col("_bucket")).cast("int").alias("bucket"), F.lit(True).alias("guest"))
        sent = F.when(is_head, F.array(own, guest)).otherwise(sent)
    dealt = rows.select(*[c for c in rows.columns if c != "_bucket"], F.explode(sent).alias("_to"))
    inside = Window.partitionBy("_to.bucket").orderBy("_to.guest", F.coalesce(F.col(key), F.lit(lowest)).desc(), F.col(tie).desc())
    led = dealt.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("_to.guest")).drop("_to")


def edited_likeness(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited form replaces the last third of a text's characters by the first as many of the next document. A null text
    is empty; a repeated row is a document of its own; no rows give no rows; other columns are not read.
    """
    rows = documents.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_fingerprint(rows, "text", "print").withColumn("tie", F.xxhash64("text"))
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = with_next(rows, "doc_id", "tie", ["text", "print"], n_ranges(size))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    rows = with_fingerprint(rows.select("*", n.cast("long").alias("n_chars"), edited.alias("edited")), "edited", "edited_print")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_hex(F.col("print")).alias("fingerprint"),
        as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
