"""Retrieval of lines of source text: index with declarations, document frequencies, overlap and BM25 ranking, filters, groups by declaration and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.scalars import language, terms, under, utf16_order
from symweave.operators.graph import covering, resolve
from symweave.session import stage
from symweave.sources.records import one_text

#: What a line of the declaration that the query names exactly gets on top.
EXACT = 1000.0


def line_documents(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(file, line, anchor, terms, field_terms)``: one document per line that has a term.

    anchor is the smallest declaration whose lines hold the line, ties by id, null for none. field_terms are the terms of the path and of the anchor's id, terms those and the line's.
    """
    texts = one_text(sources)
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("n", "body")).where(F.col("body").rlike(r"[\p{L}\p{N}]")).select("file", (F.col("n") + 1).alias("line"), "body")
    spans = nodes.where("kind <> 'file'").select("id", "file", "line", "end_line")
    met = covering(lines.select(F.struct("file", "line").alias("site"), "file", "line"), spans, "site")
    anchors = met.groupBy("site").agg(F.min(F.struct((F.col("end_line") - F.col("line")).alias("span"), "id")).alias("m")).select("site.file", "site.line", F.col("m.id").alias("anchor"))
    rows = lines.join(anchors, ["file", "line"], "left")
    fields = F.array_union(terms("file"), F.coalesce(terms("anchor"), F.array().cast("array<string>")))
    return rows.select("file", "line", "anchor", F.array_union(terms("body"), fields).alias("terms"), fields.alias("field_terms"))


def document_frequencies(documents: DataFrame) -> DataFrame:
    """``(term, df)`` over documents whose terms are distinct; combined before the shuffle."""
    return documents.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def scored(documents: DataFrame, query: str, nodes: DataFrame, *, ranking: str = "bm25", prefix: str | None = None, lang: str | None = None, anchor: str | None = None, kind: str | None = None, tag: str | None = None) -> DataFrame:
    """``(file, line, anchor, score, matched)`` of every document with a term of the query, or of the declaration that the query names exactly.

    ``overlap`` adds ln((N+1)/(df+1))+1 of each matched term; ``bm25`` has idf ln(1+(N-df+.5)/(df+.5)), k1 1.2, b .75, a term frequency of
    one, and counts a field's term twice. A line of the exactly named declaration gets EXACT on top. ``prefix`` and ``lang`` limit the index that the statistics come from; ``anchor``, ``kind`` and ``tag`` of the
    anchor are filters after it. The documents are tokenised once and written to the shared folder.
    """
    spark = documents.sparkSession
    wanted = [r["t"] for r in spark.range(1).select(F.explode(terms(F.lit(query))).alias("t")).collect()]
    if not wanted:
        raise ValueError("a query needs a term")
    if prefix:
        documents = documents.where(under("file", prefix))
    if lang:
        documents = documents.where(language("file") == lang)
    documents = stage(documents, "lines")
    named = resolve(spark.createDataFrame([(query,)], "target string"), nodes).select("id").first()
    exact = F.coalesce(F.col("anchor") == named["id"], F.lit(False)) if named and named["id"] else F.lit(False)
    sizes = documents.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avg"), *[F.sum(F.array_contains("terms", t).cast("long")).alias(f"df{i}") for i, t in enumerate(wanted)]).first()
    n, mean = sizes["n"] or 0, max(sizes["avg"] or 0.0, 1.0)
    score = F.when(exact, EXACT).otherwise(0.0)
    for i, t in enumerate(wanted):
        df = sizes[f"df{i}"] or 0
        if ranking == "overlap":
            one = F.log(F.lit((n + 1) / (df + 1))) + 1
        else:
            idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
            one = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * F.size("terms") / mean)) * F.when(F.array_contains("field_terms", t), 2).otherwise(1)
        score = score + F.when(F.array_contains("terms", t), one).otherwise(0.0)
    hits = F.size(F.array_intersect("terms", F.array(*[F.lit(t) for t in wanted])))
    found = documents.where((hits > 0) | exact)
    if anchor:
        found = found.where(F.col("anchor") == anchor)
    if kind or tag:
        own = nodes.where(F.col("kind") == kind) if kind else nodes
        own = own.where(F.array_contains("tags", tag)) if tag else own
        found = found.join(own.select(F.col("id").alias("anchor")), "anchor", "left_semi")
    return found.select("file", "line", "anchor", score.alias("score"), hits.alias("matched"))


def rank(documents: DataFrame, query: str, nodes: DataFrame, limit: int = 50, **kw) -> DataFrame:
    """The best ``limit`` rows of :func:`scored`, by score, file and line."""
    return scored(documents, query, nodes, **kw).orderBy(F.desc("score"), "file", "line").limit(limit)


def grouped(found: DataFrame, limit: int = 50) -> DataFrame:
    """``(file, line, anchor, score, matched, match_count, match_lines)``: the best row of each declaration, or of the lines of a file that have none, of the rows of :func:`scored`.

    match_lines are the first three in order of rank. Only three rows of a group are ranked after the shuffle, so a declaration of very many lines is a short window.
    """
    rows = found.withColumn("_group", F.coalesce("anchor", F.concat("file", F.lit("::file"))))
    by = Window.partitionBy("_group").orderBy(F.desc("score"), "file", "line")
    top = rows.withColumn("_n", F.row_number().over(by)).where("_n <= 3")
    lines = top.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("_n", "line"))).alias("l"), F.min_by(F.struct("file", "line", "anchor", "score", "matched"), "_n").alias("b"))
    counts = rows.groupBy("_group").agg(F.count("*").alias("match_count"))
    best = lines.join(counts, "_group").select("b.*", "match_count", F.array_join(F.transform("l", lambda x: x["line"].cast("string")), " ").alias("match_lines"))
    return best.orderBy(F.desc("score"), "file", "line").limit(limit)


def expanded(selected: DataFrame, edges: DataFrame, direction: str = "callers", steps: int = 40) -> DataFrame:
    """``(source, target, kind, file, line, start_offset)``: the relations of the selected rows' declarations, callers or dependencies, at most ``steps`` in the order of the declarations' ids, kinds and keys; equal ones once."""
    end = "target" if direction == "callers" else "source"
    anchors = selected.select("anchor").where("anchor is not null").distinct()
    rows = edges.where("kind in ('calls', 'references', 'overrides')").join(anchors, F.col(end) == F.col("anchor"))
    place = F.array_position(F.array(F.lit("calls"), F.lit("references"), F.lit("overrides")), F.col("kind"))
    key = utf16_order(F.concat_ws("|", "source", "target", "kind", "file", F.col("start_offset").cast("string")))
    return rows.orderBy("anchor", place, key).limit(steps).select("source", "target", "kind", "file", "line", "start_offset").distinct()


def best_per_file(documents: DataFrame, query_terms: list[str], k: int = 1) -> DataFrame:
    """``(file, line, matched, n_matches)``: per file the ``k`` lines with most of the terms, and how many lines have one."""
    hits = F.size(F.array_intersect("terms", F.array(*[F.lit(t) for t in query_terms])))
    rows = documents.select("file", "line", hits.alias("matched")).where("matched > 0")
    by = Window.partitionBy("file").orderBy(F.desc("matched"), "line")
    best = rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k).drop("_n")
    return best.join(rows.groupBy("file").agg(F.count("*").alias("n_matches")), "file").select("file", "line", "matched", "n_matches")


def name_postings(nodes: DataFrame, most: int = 100) -> DataFrame:
    """``(term, df, first_ids)``: a report of the inverted index of qualified names; each term lists its first ids up to ``most``, :func:`posting_blocks` has all.

    The list is cut from a window that ranks within the term, after the count, so a term of all names stays one bounded row.
    """
    rows = nodes.where("kind not in ('file', 'external')").select("id", F.explode(terms("qualified")).alias("term"))
    counted = rows.groupBy("term").agg(F.count("*").alias("df"))
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy(utf16_order("id")))).where(F.col("n") <= most)
    listed = placed.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
    return counted.join(listed, "term").select("term", "df", F.array_join("ids", " ").alias("first_ids"))


def posting_blocks(nodes: DataFrame, size: int = 1000) -> DataFrame:
    """``(term, block, first, ids)``: the whole inverted index of qualified names; no id is left out.

    The ids of a term lie in blocks of about ``size`` by their hash, at most a few times as many; ``block`` numbers the blocks of a term that have an
    id from 0 on, ``first`` counts the ids in blocks before, and ids are in UTF-16 order within a block. No task sorts all rows of a term: only counts of blocks meet in a
    window. Repeated ids count once; null ids, files and externals have no postings. An empty table gives no rows.
    """
    rows = nodes.where("kind not in ('file', 'external') and id is not null").select("id", F.explode(terms("qualified")).alias("term")).distinct()
    counted = rows.groupBy("term").agg(F.count("*").alias("df"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / size)).alias("part")
    blocks = rows.join(counted, "term").select("term", part, "id").groupBy("term", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct(utf16_order("id").alias("o"), "id"))), lambda x: x["id"]).alias("ids"))
    blocks = stage(blocks, "postings")
    order = Window.partitionBy("term").orderBy("part")
    places = blocks.select("term", "part", F.size("ids").alias("n")).select("term", "part", (F.row_number().over(order) - 1).alias("block"), (F.sum("n").over(order) - F.col("n")).alias("first"))
    return blocks.join(places, ["term", "part"]).select("term", "block", "first", "ids")
