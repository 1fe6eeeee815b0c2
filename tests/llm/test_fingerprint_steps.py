"""The steps of a fingerprint: what they give, and that they sort plain numbers."""

from pyspark.sql import functions as F

from corpusflow.llm import fingerprints as fp


def test_fingerprints_are_those_of_the_plain_definition(spark):
    """The smallest hash of each bin, empty bins lent one by the full order of probes; texts of few words go beyond the first look."""
    texts = [(-1, None), (-2, ""), (-3, " \n "), *[(n, " ".join(f"w{j * n % 97}" for j in range(n))) for n in (1, 2, 4, 5, 6, 40, 300, 3000)]]
    rows = spark.createDataFrame(texts, "id long, text string")
    orders = spark.range(fp.BINS).select(F.hash(F.col("id").cast("int")).alias("a"), F.hash(F.col("id").cast("int"), F.lit(1)).alias("b"), "id").collect()
    orders = {r.id: [(r.a % fp.BINS + t * (r.b % (fp.BINS // 2) * 2 + 1)) % fp.BINS for t in range(fp.BINS)] for r in orders}
    words = rows.select("id", fp.shingle_hashes(F.col("text")).alias("w")).localCheckpoint()
    some = words.where("size(w) > 0").select("id", F.explode(F.expr("transform(sequence(1, greatest(size(w) - 4, 1)), i -> slice(w, i, 5))")).alias("s"))
    least: dict = {}
    for r in some.select("id", F.xxhash64("s").alias("h")).collect():
        own, h = least.setdefault(r.id, {}), r.h & ((fp.BINS << 32) - 1)
        own[h >> 32] = min(own.get(h >> 32, h), h)
    values = []
    for id_, own in least.items():
        for i in range(fp.BINS):
            at = i if i in own else next(p for p in orders[i] if p in own)
            values.append((id_, i, own[at] & (2**32 - 1), i in own))
    lent = spark.createDataFrame(values, "id long, i int, v long, own boolean")
    low = F.when(F.col("own"), F.col("v")).otherwise(F.xxhash64("v", "i")).bitwiseAND(F.lit((1 << fp.BITS) - 1)).alias("low")
    wanted: dict = {}
    for r in lent.select("id", "i", low).collect():
        wanted.setdefault(r.id, {})[r.i] = r.low
    found = fp.with_fingerprint(rows, "text", "p").select("id", fp.as_hex(F.col("p")).alias("p")).collect()
    assert {r.id: r.p for r in found} == {i: "".join(f"{wanted[i][k]:X}" for k in range(fp.BINS)) if i in wanted else "" for i, _ in texts}


def test_no_array_that_is_sorted_may_hold_nulls(spark):
    """Spark sorts plain numbers as such, and others as objects with a comparator."""
    rows = spark.createDataFrame([("a b c d e f",)], "text string").select(fp.shingle_hashes(F.col("text")).alias("w"))
    shingles = rows.select(fp._shingles(F.col("w")).alias("s"))
    assert not shingles.schema["s"].dataType.containsNull
    assert not shingles.select(fp._sorted(F.col("s")).alias("s")).schema["s"].dataType.containsNull
