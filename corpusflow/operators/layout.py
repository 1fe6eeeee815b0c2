"""Page layout: text items to lines, header and footer removal, paragraphs, page texts.

Work is keyed by ``(doc_id, page_no)``, so a long document spreads over many
tasks; only the final text, one row per document, gathers a document's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import fixed_values as fv
from corpusflow.functions.templates import render
from corpusflow.functions.text import (
    is_edge_candidate,
    is_likely_heading,
    is_page_number,
    let,
    normalize_line,
    strip,
)

PAGE = ["doc_id", "page_no"]


def finite_or_zero(c: Column) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(c)


def rounded(c: Column) -> Column:
    """Round half up to a whole number; bad values are zero."""
    return F.floor(finite_or_zero(c) + 0.5).cast("int")


def _item_pages(items: DataFrame) -> DataFrame:
    """Positioned items to ``(doc_id, page_no, lines)``: the lines of a page in its row, blank ones left out.

    An item joins the first line anchor within the merge gap, in item order. Items meet by page in one shuffle; from there on
    nothing is grouped again: a page's items are put in order of line and place, and cut where the line changes.
    """
    placed = items.filter(F.col("doc_id").isNotNull()).select(
        *PAGE,
        F.struct("item_no", rounded(F.col("y")).alias("y"), finite_or_zero(F.col("x")).alias("x"), "str").alias("item"),
    )
    # moved as plain rows: lists that are begun before the shuffle would sort, and spill, all items of a split
    pages = placed.repartition(*PAGE).groupBy(*PAGE).agg(F.array_sort(F.collect_list("item")).alias("items"))

    def near(anchors: Column, y: Column) -> Column:
        return F.filter(anchors, lambda a: F.abs(a - y) <= fv.LINE_MERGE_GAP)

    # a height seen again finds the anchor it found before, so distinct heights are enough
    anchors = F.aggregate(
        F.array_distinct(F.transform("items", lambda it: it["y"])),
        F.array().cast("array<int>"),
        lambda acc, y: F.when(F.size(near(acc, y)) > 0, acc).otherwise(F.array_append(acc, y)),
    )

    def in_order(found: Column) -> Column:
        # from the top: the complement turns the order of heights round
        heights = F.transform("items", lambda it: F.struct(F.bitwise_not(near(found, it["y"])[0]).alias("below"), it["x"].alias("x"), it["item_no"].alias("item_no"), it["str"].alias("str")))
        return F.array_sort(heights)

    def cut(ordered: Column) -> Column:
        numbers = F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1)))
        starts = F.filter(numbers, lambda i: (i == 1) | (F.get(ordered, i - 1)["below"] != F.get(ordered, i - 2)["below"]))

        def lines(begins: Column) -> Column:
            end = F.size(ordered) + 1
            runs = F.transform(begins, lambda s, k: F.slice(ordered, s, F.coalesce(F.get(begins, k + 1), end) - s))
            texts = F.transform(runs, lambda run: normalize_line(F.array_join(F.transform(run, lambda i: i["str"]), " ")))
            return F.filter(texts, lambda line: F.length(line) > 0)

        return let(starts, lines)

    return pages.select(*PAGE, let(let(anchors, in_order), cut).alias("lines"))


def items_to_lines(items: DataFrame) -> DataFrame:
    """Positioned items to ``(doc_id, page_no, line_no, line)``, with one shuffle; see ``_item_pages``."""
    return _item_pages(items).select(*PAGE, F.posexplode("lines").alias("line_no", "line"))


def lines_to_pages(lines: DataFrame) -> DataFrame:
    """Line rows to one row per page with the ordered ``lines`` array."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(*PAGE).agg(F.transform(ordered, lambda s: s["line"]).alias("lines"))


def repeated_edges(pages: DataFrame) -> DataFrame:
    """``(doc_id, line, pages)``: candidates among lines 1, 2 and last that recur on three pages or more."""
    edges = F.array_distinct(
        F.filter(
            F.array(F.get("lines", F.lit(0)), F.get("lines", F.lit(1)), F.element_at("lines", -1)),
            lambda x: x.isNotNull() & is_edge_candidate(x),
        )
    )
    # one row per page and line already, so a plain count is the page count
    return (
        pages.filter(F.size("lines") > 0)
        .select("doc_id", F.explode(edges).alias("line"))
        .groupBy("doc_id", "line")
        .agg(F.count("*").alias("pages"))
        .filter(F.col("pages") >= fv.EDGE_MIN_REPEAT)
    )


def strip_repeated_edges(pages: DataFrame) -> DataFrame:
    """Drop the repeated edge lines of a document from its pages.

    The edge lines are a small aggregate; the pages meet them by ``doc_id`` and
    filter their own array, so no line row is shuffled.
    """
    edges = repeated_edges(pages).groupBy("doc_id").agg(F.collect_set("line").alias("edges"))
    joined = pages.join(edges, "doc_id", "left")
    kept = F.when(
        F.col("edges").isNotNull(), F.filter("lines", lambda x: ~F.array_contains("edges", x))
    ).otherwise(F.col("lines"))
    return joined.select(*PAGE, kept.alias("lines"))


def drop_page_numbers(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~is_page_number(x))


def rebuilt_paragraphs(lines: Column) -> Column:
    """Lines of one page to paragraphs, with words joined over a trailing hyphen."""

    def opens(previous: Column, line: Column) -> Column:
        starts = [line.rlike(p) for p in fv.PARAGRAPH_START_PATTERNS]
        return is_likely_heading(line) | previous.rlike(fv.PARAGRAPH_END_PATTERN) | starts[0] | starts[1]

    numbers = F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)))
    first = F.filter(
        numbers, lambda i: (i == 1) | opens(F.get(lines, i - 2), F.get(lines, i - 1))
    )

    def join(group: Column) -> Column:
        marked = F.array_join(group, "\x01")
        whole_words = F.regexp_replace(marked, "-\x01(?=[A-Za-z])", "")
        return F.when(F.size(group) == 1, strip(group[0])).otherwise(
            normalize_line(F.translate(whole_words, "\x01", " "))
        )

    def build(starts: Column) -> Column:
        end = F.size(lines) + 1
        groups = F.transform(
            starts, lambda s, k: F.slice(lines, s, F.coalesce(F.get(starts, k + 1), end) - s)
        )
        return F.filter(F.transform(groups, join), lambda p: F.length(p) > 0)

    return F.when(F.size(lines) > 0, let(first, build)).otherwise(F.array().cast("array<string>"))


def page_texts(pages: DataFrame) -> DataFrame:
    """``(doc_id, page_no, page_text)``; pages without paragraphs are dropped, numbers are kept."""
    return (
        pages.select(*PAGE, rebuilt_paragraphs(F.col("lines")).alias("paragraphs"))
        .filter(F.size("paragraphs") > 0)
        .select(
            *PAGE,
            F.concat(
                render(fv.PAGE_HEADER, page=F.col("page_no")), F.array_join("paragraphs", "\n\n")
            ).alias("page_text"),
        )
    )


def assemble_pages(texts: DataFrame) -> DataFrame:
    """One text per document, pages in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "page_text")))
    joined = F.array_join(F.transform(ordered, lambda s: s["page_text"]), "\n\n")
    return texts.groupBy("doc_id").agg(strip(joined).alias("text"))


def document_edges(pages: Column) -> Column:
    """The lines that ``repeated_edges`` finds, of a document's array of pages (struct with ``lines``)."""

    def candidates(lines: Column) -> Column:
        three = F.array(F.get(lines, F.lit(0)), F.get(lines, F.lit(1)), F.get(lines, F.size(lines) - 1))
        return F.array_distinct(F.filter(three, lambda x: x.isNotNull() & is_edge_candidate(x)))

    def repeated(found: Column) -> Column:
        # sorted, a line that is there often enough equals the one so many places on
        same = F.filter(found, lambda x, i: F.get(found, i + (fv.EDGE_MIN_REPEAT - 1)) == x)
        return F.array_distinct(same)

    return let(F.array_sort(F.flatten(F.transform(pages, lambda p: candidates(p["lines"])))), repeated)


def clean_layout(items: DataFrame) -> DataFrame:
    """Items to clean document texts.

    Two shuffles: items meet by page, pages by document. There the repeated edges are found in the document's own row, its pages become
    rows again where they are, and their texts meet by document without moving.
    Documents that end up blank are kept with ``error = EMPTY_CONTENT``.
    """
    pages = _item_pages(items).filter(F.size("lines") > 0)
    gathered = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page_no", "lines")).alias("pages"))
    edged = gathered.select("doc_id", document_edges(F.col("pages")).alias("edges"), F.explode("pages").alias("page"))
    kept = F.when(F.size("edges") > 0, F.filter("page.lines", lambda x: ~F.array_contains("edges", x))).otherwise(F.col("page.lines"))
    cleaned = edged.select("doc_id", F.col("page.page_no").alias("page_no"), drop_page_numbers(kept).alias("lines"))
    texts = cleaned.select(*PAGE, rebuilt_paragraphs(F.col("lines")).alias("paragraphs")).select(
        *PAGE,
        F.when(
            F.size("paragraphs") > 0,
            F.concat(render(fv.PAGE_HEADER, page=F.col("page_no")), F.array_join("paragraphs", "\n\n")),
        ).alias("page_text"),
    )
    # null page texts are skipped by the join but keep their document
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "page_text")))
    joined = F.array_join(F.transform(ordered, lambda s: s["page_text"]), "\n\n")
    return texts.groupBy("doc_id").agg(strip(joined).alias("text")).withColumn(
        "error", F.when(F.length("text") == 0, F.lit("EMPTY_CONTENT"))
    )
