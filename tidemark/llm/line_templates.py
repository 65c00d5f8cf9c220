"""Line dedup by log templates: lines of a template that recurs across documents are dropped.

A line is a part of a text between line feeds; its tokens stand between white space, and a token with
a digit is a variable field, written <*>. The tree has a fixed depth: a line's leaf is given by its
number of tokens and its first LEADING tokens. A leaf holds as many templates as its lines make: a token is a
constant at its place if `min_docs` lines of the leaf have it there, and a line's template is its tokens with all others
written <*>. It counts if SIMILARITY of a hundred tokens behind the leading ones, which the leaf gives, are constants;
so lines that only begin alike are no template.

Three kinds of lines go:

* all lines of a template, generalised like this, that stands in `min_docs` documents or more;
* all lines that are equal but for their fields and stand in `min_docs` documents or more;
* of such lines with LONG_TOKENS tokens or more that stand in two documents or more, all but those of the first
  document (by id, then by a hash of the text): a passage stays once.

Texts are masked once, as a whole and in time proportional to their length, and their lines kept in the shared
folder. Everything is a DataFrame operation. Rows of a hot leaf, token or template are counted by partial sums
and are never gathered: a line's template is known by two sums of hashes over its tokens. What is joined is broadcast
if it has BROADCAST_ROWS rows or fewer, and otherwise shuffled, where Spark splits large partitions.

Defined results: lines without tokens are kept and count nowhere; a null text stays null and an empty
one empty, each with no lines; a text that loses every line becomes empty; repeated rows (same id,
same text) count as one document and get the same result each; null ids are one id, the first; all columns of the
documents are returned, and one named like an added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import cut, free_name, stored

LEADING = 3
SIMILARITY = 60
MIN_DOCS = 10
#: Tokens of lines that recur if two documents have them.
LONG_TOKENS = 20
#: Rows of hashes and counts (under 100 bytes each) that a join broadcasts.
BROADCAST_ROWS = 100_000
FIELD = "<*>"
#: White space within lines, where it is not one blank; and tokens with a digit, each looked at from its beginning only.
BLANKS = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
NUMBERED = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+"


def masked_text(text: Column) -> Column:
    """The text with single blanks between the tokens of a line, and fields masked; line feeds stay."""
    plain = F.regexp_replace(text, BLANKS, " ")
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, NUMBERED, FIELD)).otherwise(plain)


def text_hash(text_column: str) -> Column:
    return F.xxhash64(text_column)


def _id_key(value: Column) -> Column:
    """An id as a text, that of null apart from all others."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def document_lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows row, id, hash, line_no, masked and path for each line with a token; `row` tells repeated rows apart."""
    row, key = F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id")
    numbered = docs.select(row, key, text_hash(text_column).alias("hash"), masked_text(F.col(text_column)).alias("masked"))
    lines = F.posexplode(F.split("masked", "\n", -1)).alias("line_no", "line")
    rows = numbered.select("row", "id", "hash", lines)
    return with_path(rows.select("row", "id", "hash", "line_no", F.trim("line").alias("masked")).where("masked != ''"))


def with_path(lines: DataFrame) -> DataFrame:
    """Adds the number of tokens, the leaf, and two hashes of the whole line."""
    n_tokens = F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64(F.col("n_tokens"), F.substring_index("masked", " ", LEADING))
    hashes = {"line_a": F.xxhash64("masked"), "line_b": F.xxhash64(F.lit("line"), "masked")}
    return lines.withColumn("n_tokens", n_tokens).withColumns({"leaf": leaf, **hashes})


def join_counted(rows: DataFrame, found: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join with a kept table, which is broadcast if it is small."""
    small = found.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(found) if small else found, by, how)


def counted_lines(lines: DataFrame) -> DataFrame:
    """Rows line_a, line_b, n_tokens, leaf, docs and first (the first document) of every distinct line."""
    by = ["line_a", "line_b", "n_tokens", "leaf"]
    seen = lines.select(*by, "id", "hash").distinct()
    first = F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "hash"))
    return seen.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), first.alias("first"))


def leaf_templates(lines: DataFrame, min_docs: int) -> DataFrame:
    """Rows id, hash, line_no, template_a, template_b of the lines whose template counts; `lines` are those of some leaves."""
    tokens = lines.select("row", "id", "hash", "line_no", "leaf", F.posexplode(F.split("masked", " ", -1)).alias("place", "token"))
    counts = tokens.groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("n"))
    constants = cut(counts.where((F.col("n") >= min_docs) & (F.col("token") != FIELD)).drop("n"))
    marked = join_counted(tokens, constants.withColumn("constant", F.lit(1)), ["leaf", "place", "token"], "left")
    known = F.col("constant").isNotNull()
    # Two numbers below 2 ** 32 of each place and token; their sums over a line stay far below 2 ** 63.
    token = F.when(known, F.col("token")).otherwise(FIELD)
    parts = (F.pmod(F.xxhash64(F.lit(seed), "place", token), F.lit(1 << 32)) for seed in ("a", "b"))
    sums = [F.sum(part).alias(f"sum_{name}") for part, name in zip(parts, "ab")]
    line = marked.groupBy("row", "id", "hash", "line_no", "leaf").agg(
        *sums, F.count(F.lit(1)).alias("n"), F.count_if(known & (F.col("place") >= LEADING)).alias("constants")
    )
    likely = line.where(100 * F.col("constants") >= SIMILARITY * (F.col("n") - LEADING))
    names = [F.xxhash64(F.lit(seed), "leaf", "sum_a", "sum_b").alias(f"template_{seed}") for seed in ("a", "b")]
    return likely.select("id", "hash", "line_no", *names)


def recurring_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows id, hash, line_no of the lines to drop, kept; `lines` are document_lines(), kept."""
    kept_counts = stored(counted_lines(lines))
    counts = kept_counts.frame
    everywhere = F.col("docs") >= min_docs
    often = counts.where(everywhere | ((F.col("n_tokens") >= LONG_TOKENS) & (F.col("docs") >= 2)))
    again = lines.select("id", "hash", "line_no", "line_a", "line_b").join(
        often.select("line_a", "line_b", "first", everywhere.alias("everywhere")), ["line_a", "line_b"]
    )
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash"))
    again = again.where(F.col("everywhere") | ~is_first).select("id", "hash", "line_no")

    leaves = counts.where(F.col("n_tokens") > LEADING).groupBy("leaf")
    leaves = leaves.agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("lines"))
    leaves = cut(leaves.where((F.col("docs") >= min_docs) & (F.col("lines") >= 2)).select("leaf"))
    alike = cut(leaf_templates(join_counted(lines, leaves, ["leaf"]), min_docs))
    by = ["template_a", "template_b"]
    templates = alike.select(*by, "id", "hash").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("docs"))
    templates = cut(templates.where(F.col("docs") >= min_docs).select(*by))
    general = join_counted(alike, templates, by).select("id", "hash", "line_no")
    found = cut(again.union(general).distinct())
    kept_counts.remove()
    return found


def drop_recurring(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = MIN_DOCS
) -> DataFrame:
    """`docs` without the recurring lines, with n_lines (lines with a token) and n_dropped."""
    key, digest, dropped, n_lines = (free_name(docs.columns, name) for name in ("_key", "_hash", "_dropped", "_lines"))
    lines = stored(document_lines(docs, id_column, text_column), codec="snappy")
    of_document = [_id_key(F.col("id")).alias(key), F.col("hash").alias(digest)]
    found = recurring_lines(lines.frame, min_docs).groupBy(*of_document).agg(F.collect_list("line_no").alias(dropped))
    # Repeated rows have equally many.
    counts = lines.frame.groupBy("row", "id", "hash").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy(*of_document).agg(F.max("n").alias(n_lines))
    by_document = cut(counts.join(found, [key, digest], "left"))
    lines.remove()
    named = docs.withColumns({key: _id_key(F.col(id_column)), digest: text_hash(text_column)})
    joined = named.join(by_document, [key, digest], "left")
    lines = F.split(text_column, "\n", -1)
    # Places that stay, in order; both steps take time proportional to the number of lines.
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    kept = F.array_join(F.transform(places, lambda place: F.get(lines, place)), "\n")
    text = F.when(F.col(dropped).isNull(), F.col(text_column)).otherwise(kept)
    added = {"n_lines": F.coalesce(n_lines, F.lit(0).cast("bigint")), "n_dropped": F.coalesce(F.size(dropped), F.lit(0)).cast("bigint")}
    return joined.withColumns(added).withColumn(text_column, text).drop(key, digest, dropped, n_lines)
