"""Reading texts by the graph: snippets of symbols, regions of an extraction, and what edits leave as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.scalars import language
from symweave.operators.graph import covering
from symweave.sources.records import one_text


def first_units(text: str | Column, most: int) -> Column:
    """The beginning of a text with at most ``most`` UTF-16 units, whole characters only."""
    text = F.col(text) if isinstance(text, str) else text
    raw = F.encode(text, "UTF-16BE")
    cut = F.substring(raw, 1, 2 * most)
    half = F.hex(F.substring(cut, 2 * most - 1, 1)).isin("D8", "D9", "DA", "DB")
    return F.when(F.octet_length(raw) <= 2 * most, text).otherwise(F.decode(F.when(half, F.substring(cut, 1, 2 * most - 2)).otherwise(cut), "UTF-16BE"))


def snippets(nodes: DataFrame, sources: DataFrame, *, context: int = 2, max_lines: int = 120, max_units: int = 16_000) -> DataFrame:
    """``(id, file, start_line, end_line, truncated, text)``: the lines of every symbol with ``context`` lines around, clamped to the file, ``max_lines`` and ``max_units`` UTF-16 units.

    Lines end at line feeds and keep their carriage returns. Symbols with a line below 1 or past the text, or an end before their line, have no snippet. Lines meet the symbols by a range join, so a symbol's row holds at most
    ``max_lines`` lines and no text is copied for each of its symbols.
    """
    if not 0 <= context <= 20:
        raise ValueError("context must be 0..20")
    texts = one_text(sources)
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("n", "body")).select("file", (F.col("n") + 1).alias("line"), "body")
    sizes = texts.select("file", F.size(F.split("text", "\n")).alias("size"))
    asked = nodes.where("line >= 1 and end_line >= line").select("id", "file", "line", "end_line").join(sizes, "file").where("line <= size")
    start, desired = F.greatest(F.col("line") - context, F.lit(1)), F.least(F.col("end_line") + context, F.col("size"))
    asked = asked.select("id", "file", start.alias("line"), desired.alias("desired")).withColumn("end_line", F.least(F.col("desired"), F.col("line") + max_lines - 1))
    held = covering(lines.select(F.struct("line", "body").alias("site"), "file", "line"), asked, "site")
    whole = held.groupBy("id", "file", "line", "end_line", "desired").agg(F.array_join(F.transform(F.sort_array(F.collect_list("site")), lambda x: x["body"]), "\n").alias("whole"))
    rows = whole.select("id", "file", F.col("line").alias("start_line"), ((F.col("end_line") < F.col("desired")) | (F.octet_length(F.encode("whole", "UTF-16BE")) > 2 * max_units)).alias("truncated"), first_units("whole", max_units).alias("text"))
    return rows.select("id", "file", "start_line", (F.col("start_line") + F.size(F.split("text", "\n")) - 1).cast("long").alias("end_line"), "truncated", "text")


def merge_windows(windows: DataFrame) -> DataFrame:
    """``(file, start_line, end_line, n_windows, conflict, text)`` of windows (file, start_line, text): those that overlap or touch as one; conflict if they have different texts for a line.

    Every line of a file counts once, however many windows hold it, and combined before the shuffle; so what meets in a file is its lines. A conflicting line shows the least of its texts. n_windows counts windows by their first line.
    """
    lines = windows.where("file is not null and start_line is not null and text is not null").select("file", "start_line", F.posexplode(F.split("text", "\n")).alias("n", "body"))
    once = lines.groupBy("file", (F.col("start_line") + F.col("n")).alias("line")).agg(F.min("body").alias("body"), F.max("body").alias("other"), F.count(F.when(F.col("n") == 0, 1)).alias("begun"))
    marked = once.withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("file").orderBy("line")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n").alias("text")
    return marked.groupBy("file", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.sum("begun").alias("n_windows"), F.max(F.col("body") != F.col("other")).alias("conflict"), text).drop("island")


def freshness(files: DataFrame, sources: DataFrame) -> DataFrame:
    """``(file, state)`` of the current records: ``same`` if the text has the record's hash, ``stale`` if not, ``missing`` without a text; digests are shuffled, not texts."""
    newest = files.where("file is not null").groupBy("file").agg(F.max(F.struct("indexed_at", F.lower("hash").alias("hash"))).alias("r")).select("file", "r.hash")
    digests = sources.where("file is not null and text is not null").groupBy("file").agg(F.max(F.sha2("text", 256)).alias("digest"))
    state = F.when(F.col("digest").isNull(), "missing").when(F.col("digest").eqNullSafe(F.col("hash")), "same").otherwise("stale")
    return newest.join(digests, "file", "left").select("file", state.alias("state"))


def regions(statements: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(region, file, scope, start_offset, end_offset, n_statements)`` of wanted ranges of lines (region, file, start_line, end_line): the statements that an extraction takes.

    If one statement alone spans the range, it is the region; else the first that starts on the first line and the last that ends on the last one must stand in one block and scope, and the region is the statements of
    these within the range. Ranges without such statements give no row.
    """
    spans = wanted.select("region", "file", F.col("start_line").alias("line"), "end_line")
    found = covering(statements.select(F.struct("line", "end", "offset", "end_offset", "scope", "block").alias("s"), "file", "line"), spans, "s").where("s.end <= end_line")
    exact = (F.col("s.line") == F.col("line")) & (F.col("s.end") == F.col("end_line"))
    first = F.min(F.when(F.col("s.line") == F.col("line"), F.struct("s.offset", "s.end_offset", "s.scope", "s.block"))).alias("first")
    last = F.max(F.when(F.col("s.end") == F.col("end_line"), F.struct("s.end_offset", "s.offset", "s.scope", "s.block"))).alias("last")
    ends = found.groupBy("region", "file").agg(F.count(F.when(exact, 1)).alias("n_exact"), F.max(F.when(exact, F.struct("s.offset", "s.end_offset", "s.scope"))).alias("one"), first, last)
    alone = ends.where("n_exact = 1").select("region", "file", "one.scope", F.col("one.offset").alias("start_offset"), F.col("one.end_offset").alias("end_offset"), F.lit(1).cast("long").alias("n_statements"))
    several = ends.where("n_exact <> 1 and first.scope <=> last.scope and first.block <=> last.block and first is not null and last is not null").select(F.col("region").alias("_r"), F.col("file").alias("_f"), F.col("first.scope").alias("_s"), F.col("first.block").alias("_b"))
    inside = found.join(several, (F.col("region") == F.col("_r")) & (F.col("file") == F.col("_f")) & F.col("s.scope").eqNullSafe(F.col("_s")) & F.col("s.block").eqNullSafe(F.col("_b")))
    many = inside.groupBy("region", "file", F.col("_s").alias("scope")).agg(F.min("s.offset").alias("start_offset"), F.max("s.end_offset").alias("end_offset"), F.count("*").alias("n_statements"))
    return alone.unionByName(many)


def extraction(found: DataFrame, bindings: DataFrame, uses: DataFrame, controls: DataFrame) -> DataFrame:
    """``(region, file, fact, binding, n)`` of :func:`regions`: what moving the region into a declaration of its own would need.

    capture_reads and external_mutations are bindings from outside that are read or written within the region, locals_used_after bindings from within that are used behind it in its scope, control_exits the kinds of
    control within it; n counts the uses. Offsets meet regions by a range join; uses behind a region by its scope.
    """
    spans = found.select("region", "file", F.col("scope").alias("own_scope"), F.col("start_offset").alias("line"), (F.col("end_offset") - 1).alias("end_line"))
    declared = bindings.select(F.col("file").alias("_f"), F.col("id").alias("_id"), F.col("offset").alias("_at")).distinct()
    used = covering(uses.where("binding is not null").select(F.struct("offset", "binding", "read", "write").alias("u"), "file", F.col("offset").alias("line")), spans, "u")
    used = used.select("region", "file", F.col("u.binding").alias("binding"), F.col("u.read").alias("read"), F.col("u.write").alias("write"), F.col("line").alias("_lo"), F.col("end_line").alias("_hi"))
    outside = used.join(declared, (F.col("file") == F.col("_f")) & (F.col("binding") == F.col("_id"))).where("_at < _lo or _at > _hi")
    fact = F.explode(F.array_compact(F.array(F.when(F.col("read"), "capture_reads"), F.when(F.col("write"), "external_mutations")))).alias("fact")
    captured = outside.select("region", "file", fact, "binding")
    inner = covering(bindings.select(F.col("id").alias("b"), "file", F.col("offset").alias("line")), spans, "b").select("region", "file", F.col("b").alias("binding"), "own_scope", F.col("end_line").alias("_hi")).distinct()
    later = uses.select(F.col("file").alias("_f"), F.col("binding").alias("_id"), F.col("scope").alias("_scope"), F.col("offset").alias("_at"))
    after = inner.join(later, (F.col("file") == F.col("_f")) & (F.col("binding") == F.col("_id")) & F.col("own_scope").eqNullSafe(F.col("_scope")) & (F.col("_at") > F.col("_hi"))).select("region", "file", F.lit("locals_used_after").alias("fact"), "binding")
    exits = covering(controls.select(F.struct("offset", "kind").alias("c"), "file", F.col("offset").alias("line")), spans, "c").select("region", "file", F.lit("control_exits").alias("fact"), F.col("c.kind").alias("binding"))
    return captured.unionByName(after).unionByName(exits).groupBy("region", "file", "fact", "binding").agg(F.count("*").alias("n"))


def inert_leading_edit(file: str, before: str, after: str) -> Column:
    """Whether an edit of a text (names of columns) only added or took away blank lines and ``//`` comments at its begin."""
    prefix = F.when(F.endswith(after, F.col(before)), F.expr(f"left({after}, length({after}) - length({before}))")).when(F.endswith(before, F.col(after)), F.expr(f"left({before}, length({before}) - length({after}))"))
    lines = F.transform(F.split(prefix, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))
    comments = ~language(file).isin("python", "unknown")
    inert = F.forall(lines, lambda x: (x == "") | (comments & F.startswith(x, F.lit("//")) & ~F.contains(x, F.lit("\\"))))
    return F.coalesce((F.length(prefix) > 0) & F.endswith(prefix, F.lit("\n")) & inert, F.lit(False))


def unchanged_source(before: str, before_line: str, before_end: str, after: str, after_line: str, after_end: str) -> Column:
    """Whether a declaration's lines are the same in two texts (names of columns)."""
    cut = lambda text, a, b: F.slice(F.split(text, "\n"), F.col(a).cast("int"), (F.col(b) - F.col(a) + 1).cast("int"))
    fits = lambda text, a, b: (F.col(a) >= 1) & (F.col(b) >= F.col(a)) & (F.size(F.split(text, "\n")) >= F.col(b))
    same = cut(before, before_line, before_end) == cut(after, after_line, after_end)
    return F.coalesce(F.when(fits(before, before_line, before_end) & fits(after, after_line, after_end), same), F.lit(False))


def generation(files: DataFrame) -> DataFrame:
    """``(n_files, generation)``: a fingerprint of a table of (file, hash) that does not depend on order: the digest of four sums of parts of each row's digest, combined before they meet."""
    digest = F.sha2(F.concat_ws("\u0000", F.coalesce("file", F.lit("")), F.coalesce(F.lower("hash"), F.lit("-"))), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 14 * i, 14), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    total = files.select("file", "hash").distinct().agg(F.count("*").alias("n_files"), *parts)
    return total.select("n_files", F.substring(F.sha2(F.concat_ws("|", F.col("n_files").cast("string"), *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]), 256), 1, 20).alias("generation"))
