"""Page-table operators: links, reach, sitemaps, labels, sections."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import text as X
from ..functions import urls as U
from ..sources.scratch import cut, folder
from ..sources.scratch import table as written
from . import rules


def hrefs(html) -> Column:
    """All href values of anchors by pattern: enough to count links without a parser."""
    return F.regexp_extract_all(X.col(html), F.lit(r'<a href="([^"]*)"'), F.lit(1))


def plain_title(html) -> Column:
    """Title by pattern, with the common character references read and space collapsed."""
    raw = F.regexp_extract(X.col(html), r"(?s)<title>(.*?)</title>", 1)
    for a, b in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"&amp\z", "&"), r"\s+", " "))


def numbered(df: DataFrame, by: list[str], name: str = "rank", start: int = 0) -> DataFrame:
    """df with the place of each row in the order of `by`: rows are dealt into sorted ranges, a checkpoint fixes them, and only the
    counts of ranges meet in one task."""
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by)).withColumn("_place", F.monotonically_increasing_id())
    placed = placed.withColumns({"_range": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(counts.select("_range", before.alias("_before")), "_range").withColumn(name, F.col("_before") + F.col("_place") + start).drop("_range", "_place", "_before")


def reach(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """url, depth, rank of the pages that links lead to, in the order in which a crawler with one queue finds them: the pages
    that an earlier page names come first, then those that are named earlier on it.  most: the first so many alone.

    edges (src, dst, pos), seeds (url, pos).  Links are dealt by src once and what was found is dealt by url, in tables of as many
    buckets as shuffles have parts, so neither moves again; a level adds only its own rows to what was found."""
    spark = edges.sparkSession
    buckets, tag = int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
    links, found = f"links_{tag}", f"found_{tag}"
    where = folder(spark, "found")

    def add(name: str, df: DataFrame, by: str, path: str) -> None:
        df.write.bucketBy(buckets, by).mode("append").option("path", path).saveAsTable(name)

    try:
        add(links, edges.select("src", "dst", "pos").where("src is not null and dst is not null").repartition(buckets, "src"), "src", folder(spark, "links"))
        fresh, depth, total = seeds.where("url is not null").groupBy("url").agg(F.lit(0).cast("long").alias("parent"), F.min("pos").alias("pos")), 0, 0
        while True:
            level = numbered(fresh, ["parent", "pos", "url"], start=total).select("url", F.lit(depth).alias("depth"), F.col("rank").cast("long").alias("rank"))
            level = written(level if most is None else level.where(F.col("rank") < most), "level")
            n = level.count()
            if n or not depth:
                add(found, level.repartition(buckets, "url"), "url", where)
            total, depth = total + n, depth + 1
            if not n or (most is not None and total >= most):
                return spark.read.schema(level.schema).parquet(where)
            named = spark.table(links).join(level.select(F.col("url").alias("src"), F.col("rank").alias("parent")), "src")
            first = named.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("parent", "pos")).alias("first"))
            fresh = first.join(spark.table(found).select("url"), "url", "left_anti").select("url", "first.*")
    finally:
        for name in (links, found):
            spark.sql(f"DROP TABLE IF EXISTS {name}")  # the names alone: files outside the warehouse stay


def set_difference(sitemap: DataFrame, crawl: DataFrame) -> DataFrame:
    """url, side: only_in_sitemap or only_in_crawl; the latter only if there is a sitemap at all."""
    s, c = sitemap.select("url").distinct(), crawl.select("url").distinct()
    left = s.join(c, "url", "left_anti").withColumn("side", F.lit("only_in_sitemap"))
    some = s.limit(1).select(F.lit(True).alias("_some"))
    right = c.join(s, "url", "left_anti").crossJoin(F.broadcast(some)).drop("_some").withColumn("side", F.lit("only_in_crawl"))
    return left.unionByName(right)


def eligible(pages: DataFrame, host: str) -> DataFrame:
    """Pages that belong in a sitemap: answered, indexable, not redirected, own host, own canonical."""
    bare = lambda c: F.regexp_replace(c, r"/+\z", "")
    url, final = U.normalize("url"), U.normalize(X.falsy("final_url", F.col("url")))
    own = rules.missing("canonical") | (bare(U.normalize("canonical")) == bare(final))
    return pages.where((F.col("status") == 200) & ~rules.noindex() & (url == final) & (U.host_of(final) == host) & own).select(url.alias("url")).distinct()


def in_order(urls: DataFrame, extra: int) -> DataFrame:
    """url, i (its place from 0), size (bytes of the URL and `extra`), at (bytes before it), written once.

    URLs are dealt into sorted ranges, which the checkpoint fixes; only counts and bytes of whole ranges meet in one task."""
    placed = cut(urls.where("url is not null").select("url").repartitionByRange("url").sortWithinPartitions("url"))
    placed = placed.select("url", F.spark_partition_id().alias("range"), (F.octet_length("url") + extra).cast("long").alias("size"))
    sums = placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in "ns"])
    inside = Window.partitionBy("range").orderBy("url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = placed.withColumns({"i": F.count("*").over(inside), "to": F.sum("size").over(inside)}).join(before, "range")
    return written(known.select("url", (F.col("before_n") + F.col("i") - 1).alias("i"), "size", (F.col("before_s") + F.col("to") - F.col("size")).alias("at")), "entries")


def _ways(most: int, most_bytes: int, block: int, n: int):
    """For the entries of one block, given with those that follow within reach: where the chunk after the one that an entry
    begins begins (`after`), and the first such place outside the block (`out`)."""

    def one(key, rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("i")
        i, at = rows["i"].to_numpy(), rows["at"].to_numpy()
        own = int(min((key[0] + 1) * block, n) - i[0])  # the end of the table, which comes last, begins nothing
        k = np.arange(own)
        fits = np.searchsorted(at, at[:own] + most_bytes, side="right") - 1
        after = np.minimum(np.minimum(np.maximum(fits, k + 1), k + most), len(i) - 1)
        out = after.copy()
        while (out < own).any():  # each round doubles the steps
            inner = out < own
            out[inner] = out[out[inner]]
        return pd.DataFrame({"block": key[0], "i": i[:own], "after": i[after], "out": i[out]})

    return one


def _walk(key, rows):
    """The chunk of each entry of a block, counted from the one that the block's first whole chunk begins (0: begun before)."""
    import numpy as np
    import pandas as pd

    rows = rows.sort_values("i")
    i, after = rows["i"].to_numpy(), rows["after"].to_numpy()
    begins, k = np.zeros(len(i), "int64"), int(rows["enter"].iloc[0] - i[0])
    while k < len(i):
        begins[k] = 1
        k = int(after[k] - i[0])
    return pd.DataFrame({"block": key[0], "i": i, "inner": np.cumsum(begins)})


def sitemap_chunks(urls: DataFrame, most: int = C.SITEMAP_URLS, most_bytes: int = C.SITEMAP_BYTES, extra: int = 40, block: int = 1 << 16) -> DataFrame:
    """url, chunk: the greedy chunks of the URLs in order.  A chunk takes entries (a URL and `extra` bytes) until the next one
    would pass `most` or most_bytes; an entry larger than that is a chunk of its own.  A null URL is no entry.

    Where even the largest entries fit `most` times, places alone decide.  Else each block of entries is a function: from where a
    chunk begins in it to where the first chunk outside it begins.  Functions of neighbours are composed in pairs, and only that
    of a pair's first block is kept, so all levels together are no more rows than the entries; then the way down gives each
    block the place where it is entered.  A block is at least `most` entries, so a chunk never leaps over one."""
    spark, block = urls.sparkSession, max(block, most)
    entries = in_order(urls, extra)
    n, large, total = entries.agg(F.count("*"), F.max("size"), F.sum("size")).first()
    if not n or large * most <= most_bytes:
        return entries.select("url", F.floor(F.col("i") / most).cast("long").alias("chunk"))
    places = entries.select("i", "at").unionByName(spark.range(1).select(F.lit(n).cast("long").alias("i"), F.lit(total).cast("long").alias("at")))
    b = F.floor(F.col("i") / block).cast("long")
    near = (F.col("i") % block <= most) & (b > 0)  # within reach of the block before
    copies = places.select(F.explode(F.when(near, F.array(b, b - 1)).otherwise(F.array(b))).alias("block"), "i", "at")
    ways = written(copies.groupBy("block").applyInPandas(_ways(most, most_bytes, block, n), "block long, i long, after long, out long"), "ways")
    levels, blocks = [ways.select("block", "i", "out")], n // block + 1
    while blocks > 1:
        f = levels[-1]
        left, right = f.where("block % 2 = 0"), f.where("block % 2 = 1").select(F.col("i").alias("out"), F.col("out").alias("far"))
        levels.append(written(left.join(right, "out", "left").select(F.shiftright("block", 1).alias("block"), "i", F.coalesce("far", "out").alias("out")), "level"))
        blocks = (blocks + 1) // 2
    enter = spark.range(1).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("i"))
    for f in reversed(levels[:-1]):
        second = enter.join(f.select("i", "out"), "i").where(F.col("out") < n).select((F.col("block") * 2 + 1).alias("block"), F.col("out").alias("i"))
        enter = written(enter.select((F.col("block") * 2).alias("block"), "i").unionByName(second), "enter")
    walked = ways.join(enter.select("block", F.col("i").alias("enter")), "block", "left").select("block", "i", "after", F.coalesce("enter", F.lit(n)).alias("enter"))
    walked = written(walked.groupBy("block").applyInPandas(_walk, "block long, i long, inner long"), "walked")
    begun = walked.groupBy("block").agg(F.max("inner").alias("n"))
    before = begun.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n"))
    chunk = walked.join(before, "block").select("i", (F.col("n") + F.col("inner") - 1).alias("chunk"))
    return entries.join(chunk, "i").select("url", "chunk")


def _separator(title) -> Column:
    return F.coalesce(*[F.when(F.instr(X.col(title), s) > 0, s) for s in C.TITLE_SEPARATORS])


def _tail(title, sep) -> Column:
    return F.trim(F.element_at(F.split(X.col(title), F.concat(F.lit("\\Q"), X.col(sep), F.lit("\\E"))), -1))


def brand_suffix(titles: DataFrame) -> DataFrame:
    """sep, tail, n: the ending that at least half of the titles (and two) share, by the first separator that occurs."""
    rows = titles.where(~rules.missing("title")).select("title", _separator("title").alias("sep"))
    tails = rows.where("sep is not null").withColumn("tail", _tail("title", "sep")).where("tail <> ''").groupBy("sep", "tail").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    best = tails.agg(F.max_by(F.struct("sep", "tail", "n"), F.struct("n", (-F.char_length("tail")).alias("l"), "tail", "sep")).alias("b")).select("b.*")
    return best.crossJoin(F.broadcast(total)).where((F.col("n") >= 2) & (F.col("n") >= F.col("total") * 0.5)).select("sep", "tail", "n")


def labels(pages: DataFrame) -> DataFrame:
    """url, label, source: a name of the page's own, else a shared one; only what the page itself says."""
    suffix = brand_suffix(pages).select("sep", "tail")
    rows = pages.select("url", "title", F.get("h1", F.lit(0)).alias("first")).join(F.broadcast(suffix), F.lit(True), "left")  # one row at most
    cut = F.trim(F.expr("substring_index(title, sep, size(split(title, concat('\\\\Q', sep, '\\\\E'))) - 1)"))
    core = F.when(F.col("sep").isNotNull() & F.expr("endswith(title, tail)") & (F.expr("instr(title, sep)") > 0), X.falsy(cut, F.col("title"))).otherwise(F.col("title"))
    rows = rows.select("url", X.falsy("first", F.lit(None)).alias("h1"), X.falsy(core, F.lit(None)).alias("core"))
    n_h1 = rows.where("h1 is not null").groupBy("h1").agg(F.count("*").alias("n_h1"))
    n_core = rows.where("core is not null").groupBy("core").agg(F.count("*").alias("n_core"))
    rows = rows.join(n_h1, "h1", "left").join(n_core, "core", "left")
    choice = (("h1", (F.col("n_h1") == 1), "h1"), ("core", (F.col("n_core") == 1), "title"), ("h1", F.col("h1").isNotNull(), "shared_h1"), ("core", F.col("core").isNotNull(), "shared_title"))
    label = F.coalesce(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.col(c).alias("label"), F.lit(s).alias("source"))) for c, t, s in choice], F.struct(F.lit("").alias("label"), F.lit("none").alias("source")))
    return rows.select("url", label.alias("l")).select("url", "l.*")


def section_pages(pages: DataFrame, most: int = 20) -> DataFrame:
    """The shortest URL of each first path segment, the home page first, then by name; a short list for people."""
    rows = pages.select("url", "pos", U.first_segment("url").alias("section"))
    best = rows.groupBy("section").agg(F.min_by("url", F.struct(F.char_length("url").alias("n"), "pos")).alias("url"), F.count("*").alias("pages"))
    return best.orderBy(F.col("section") != "", "section").limit(most)


def section_histogram(pages: DataFrame, k: int | None = None) -> DataFrame:
    found = pages.select(X.falsy(U.first_segment("url"), "/").alias("section")).groupBy("section").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "section").limit(k) if k else found


def breadcrumbs(pages: DataFrame) -> DataFrame:
    """url, depth, item, name: the prefixes of a page's path, named by the page there (h1, else title), else by the segment.  A URL
    has its steps once, however many rows are of it."""
    rows = pages.select("url").distinct().select("url", F.concat(U.scheme_of("url"), F.lit("://"), U.host_of("url")).alias("root"), F.filter(F.split(U.part("url", 3), "/"), lambda s: s != "").alias("segments"))
    steps = rows.select("url", "root", "segments", F.explode(F.sequence(F.lit(0), F.size("segments"))).alias("depth"))
    path = F.concat(F.col("root"), F.lit("/"), F.array_join(F.slice("segments", 1, F.col("depth")), "/"))
    steps = steps.select("url", "depth", path.alias("item"), F.when(F.col("depth") > 0, U.segment_label(F.get("segments", F.col("depth") - 1))).otherwise("").alias("segment"))
    named = pages.select(F.regexp_replace(F.regexp_replace(U.normalize("url"), r"[?].*", ""), r"(?<=[^/])/\z", "").alias("_key"), X.falsy(F.get("h1", F.lit(0)), X.falsy("title", F.lit(None))).alias("_name"))
    named = named.groupBy("_key").agg(F.min("_name").alias("_name"))
    joined = steps.withColumn("_key", F.regexp_replace("item", r"(?<=[^/])/\z", "")).join(named, "_key", "left")
    return joined.select("url", "depth", "item", X.falsy("_name", F.col("segment")).alias("name"))


def draft_duplicates(drafts: DataFrame) -> DataFrame:
    """Drafts with `duplicate`: whether another draft has the same finished title; counted first, then joined back."""
    done = drafts.where(~F.col("draft_title").contains(C.TODO)).groupBy("draft_title").agg(F.count("*").alias("_n"))
    return drafts.join(done, "draft_title", "left").withColumn("duplicate", F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_n")


def bot_tally(lines: DataFrame) -> DataFrame:
    """Requests of each crawler in a text log, without regard to case; a line counts once a crawler that it names."""
    names = [u for group in C.CRAWLERS.values() for u in group]
    named = F.array_compact(F.array(*[F.when(F.lower("value").contains(n.lower()), F.lit(n)) for n in names]))
    return lines.select(F.explode(named).alias("ua")).groupBy("ua").agg(F.count("*").alias("n"))


def priority(questions: DataFrame, most: int = 10) -> DataFrame:
    """Questions by the product of three 1 to 3 axes, the first batch only."""
    return questions.withColumn("score", F.col("volume") * F.col("source") * F.col("ease")).orderBy(F.desc("score"), "id").limit(most)
