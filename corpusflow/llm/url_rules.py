"""URL filters: explicit host and path rules, and association rules over URL tokens mined from labels by FP-growth.

A URL's tokens are its scheme, the labels of its host, the segments of its path, its query pairs and its fragment, with
digits folded. FP-growth finds the token combinations that enough labelled URLs hold; those of which
enough are blocked become rules. An inverted index files each rule under its rarest token, so a URL only meets
the rules of tokens that it has, and then is held against the whole combination.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.session import materialise

ALLOW, BLOCK = "allow", "block"
#: verdict, host, start of the path
Rule = tuple[str, str, str]

#: A combination must be in so many labelled URLs, and in this share of them.
MIN_URLS = 20
MIN_SHARE = 0.001
#: So many of 100 labelled URLs with a combination must be blocked.
MIN_CONFIDENCE_PERCENT = 50
#: Of a labelled URL, combinations are made of its so many rarest frequent tokens; None: of all of them.
MAX_TOKENS = None
#: The item that stands for a blocked label; tokens have a kind and a colon in front.
_BLOCKED = "blocked"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; a null has an empty host."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; a null, or a URL without ``://``, has an empty path."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (struct of ``rule`` and ``verdict``) whose host is the URL's or a domain above it and whose path begins
    the URL's; null if none fits. Of rules that are the same but for their verdict, the first counts."""
    longest = sorted(dict.fromkeys((h + p, h, p, v) for v, h, p in rules), key=lambda r: -len(r[0]))
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(name).alias("rule"), F.lit(v).alias("verdict")))
        for name, h, p, v in longest
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: ``s:`` scheme, ``h:`` host label, ``p:`` path segment, ``q:`` query pair, ``f:`` fragment.

    Runs of digits become ``#``. A null, or a URL without ``://``, has none.
    """
    plain = F.coalesce(url, F.lit(""))

    def parts(of: Column, at: str, kind: str) -> Column:
        folded = F.transform(F.split(of, at), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
        return F.transform(F.filter(folded, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    scheme = F.translate(F.regexp_extract(plain, "(?s)^(.*?)://", 1), string.ascii_uppercase, string.ascii_lowercase)
    query = F.regexp_extract(plain, "://[^?#]*\\?([^#]*)", 1)
    fragment = F.regexp_extract(plain, "(?s)://[^#]*#(.*)$", 1)
    every = F.concat(
        parts(scheme, "\\n", "s:"), parts(host_of(url), "[.]", "h:"), parts(path_of(url), "/", "p:"), parts(query, "&", "q:"), parts(fragment, "\\n", "f:")
    )
    return F.array_distinct(every)


def transactions(labelled: DataFrame, least: int, max_tokens: int | None = MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """``items`` per row of ``url`` and ``blocked``, and the frequent tokens with their ``urls``.

    Tokens are counted and chosen once per distinct URL; the rows, of which one URL may hold very many, meet its items at the end.
    """
    distinct = materialise(labelled.groupBy("url", "blocked").agg(F.count("*").alias("n")), "labelled-urls")
    each = distinct.select("url", "blocked", "n", F.explode(tokens_of(F.col("url"))).alias("token"))
    frequent = each.groupBy("token").agg(F.sum("n").alias("urls")).where(F.col("urls") >= least)
    frequent = materialise(frequent, "frequent-tokens")
    rarest = F.array_sort(F.collect_list(F.struct("urls", "token")))["token"]
    rarest = rarest if max_tokens is None else F.slice(rarest, 1, max_tokens)
    items = materialise(each.join(frequent, "token").groupBy("url", "blocked").agg(rarest.alias("tokens")), "url-items")
    with_label = F.when(F.col("blocked"), F.array_append("tokens", F.lit(_BLOCKED))).otherwise(F.col("tokens"))
    return labelled.join(items, ["url", "blocked"]).select(with_label.alias("items")), frequent


def mine(
    labelled: DataFrame,
    min_urls: int = MIN_URLS,
    min_share: float = MIN_SHARE,
    min_confidence_percent: int = MIN_CONFIDENCE_PERCENT,
    max_tokens: int | None = MAX_TOKENS,
) -> DataFrame:
    """Rules that block, from rows of ``url`` and ``blocked``: ``tokens`` (sorted), ``urls`` and ``blocked_urls`` that hold them
    among all rows, ``confidence``, and ``filed``, the rarest token.

    All rows are learned from, repeated ones each for itself; rows with a null label, and URLs without tokens, are not there. Every frequent
    token of a URL takes part, so no combination is left out; n tokens that stand together in ``min_share`` of the rows make 2 ** n
    combinations, and a caller whose URLs share very many of them may set ``max_tokens``. No rows give no rules.
    """
    labelled = materialise(labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", "blocked"), "labelled")
    total = labelled.count()
    least = max(min_urls, -int(-total * min_share // 1), 1)
    held, frequent = transactions(labelled, least, max_tokens)
    schema = "tokens array<string>, urls long, blocked_urls long, confidence double, filed string"
    if total < least:
        return labelled.sparkSession.createDataFrame([], schema)
    # least - 0.5 keeps the share on the right side of the count it stands for
    counted = held.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(counted, 1)), minConfidence=1.0).fit(held)
    found = materialise(model.freqItemsets, "frequent-combinations")
    blocked = F.array_contains("items", _BLOCKED)
    of_blocked = found.where(blocked).select(F.array_sort(F.array_remove("items", _BLOCKED)).alias("tokens"), F.col("freq").alias("blocked_urls"))
    of_all = found.where(~blocked).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("urls"))
    rules = of_all.join(of_blocked, "tokens").where(100 * F.col("blocked_urls") >= min_confidence_percent * F.col("urls"))
    rules = rules.select("tokens", "urls", "blocked_urls", (F.col("blocked_urls") / F.col("urls")).alias("confidence"))
    each = rules.select("*", F.explode("tokens").alias("token")).join(frequent.withColumnRenamed("urls", "held"), "token")
    filed = F.min(F.struct("held", "token"))["token"].alias("filed")
    return each.groupBy("tokens", "urls", "blocked_urls", "confidence").agg(filed)


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url``, ``learned`` (its best rule's tokens) and ``confidence`` of the distinct ``url`` that mined rules fit.

    Best is the highest confidence, then the more URLs, then the later tokens. ``rules`` is a written table.
    """
    distinct = urls.select("url").where("url IS NOT NULL").distinct().withColumn("held", tokens_of(F.col("url")))
    each = distinct.select("url", "held", F.explode("held").alias("filed"))
    met = each.join(rules, "filed").where(F.size(F.array_except("tokens", "held")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "urls", "tokens")).alias("best"))
    return best.select("url", F.array_join("best.tokens", " ").alias("learned"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", **limits: float) -> DataFrame:
    """``key``, host, path, rule, verdict, learned, confidence per row of ``pages``.

    The longest fitting rule gives the verdict. Where none fits, a URL that a rule mined from ``labelled`` (``url``, ``blocked``)
    fits is blocked, any other is allowed; ``limits`` are those of ``mine``; ``learned`` and ``confidence`` say which mined rule fits best, also where another rule decides.
    A null url, or one without ``://``, has an empty host and path and is allowed; repeated rows are judged each for itself; no rows give no rows; other
    columns are not read.
    """
    mined = materialise(mine(labelled, **limits), "url-rules")
    plain = pages.select(F.col(key).alias("_key"), F.col(url).alias("url"))
    # a URL that a third of all rows share is one row here, and the larger side of the join below
    learned = materialise(matches(plain, mined), "url-matches")
    placed = plain.join(learned, "url", "left").select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = placed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("learned").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return judged.select(F.col("_key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "learned", "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url`` and ``blocked`` of the pages whose document has a label: the document is the first number that fills, or begins, a
    segment of the path; it is blocked if any of its labels says quality 0 or toxic 1."""
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]+)", 1)
    of = pages.select("url", F.when(number != "", number.try_cast("long")).alias("doc_id")).where("doc_id IS NOT NULL")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(bad).alias("blocked"))
    # written, so that a document that very many pages show can be split in the join
    return of.join(materialise(marks, "url-labels"), "doc_id").select("url", "blocked")
