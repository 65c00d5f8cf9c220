"""URL filter: allow and block rules, and gradient-boosted trees for what no rule decides.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or
the end. A rule (host, path) fits its host and all subdomains if the path starts with the rule's; the
longest wins, of equally long ones the first by name. The rules label the URLs they decide, and trees
learn from these by lexical features alone: lengths, depth, digit ratios, entropy, parameter counts,
and statistics of the host's suffixes (last label, last two) and of the path's first part, taken over
all labelled URLs.

Defined results: a null URL or one without `://` has empty host and path and no rule; the trees judge
it like any other; with labels of one kind only, or none, they give that kind, or allow; repeated
pages are judged one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import cut

# Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Labelled URLs, those with the smallest hashes, that the trees are grown from.
TRAINING_URLS = 20_000
TREES, DEPTH = 12, 4
#: Suffixes with this many labelled URLs or more have a share of their own; the others count as unknown.
MIN_SUFFIX_URLS = 20
#: Bytes of a table of shares (ROW_BYTES a row besides the text) that a join broadcasts; for a larger one the
#: URLs of each suffix are dealt into SALTS parts.
BROADCAST_BYTES, ROW_BYTES, SALTS = 8 << 20, 64, 16
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_labels", "url_digits", "host_digits", "path_digits",
    "entropy", "parameters", "query_length", "hyphens", "has_fragment", "is_https", "suffix_share", "domain_share",
    "head_share",
)


def parts(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_urls(pages: DataFrame, id_column: str, url_column: str) -> DataFrame:
    plain = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("_url"))
    host, path = parts(F.col("_url"))
    return plain.select("id", F.coalesce("_url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))


def decided(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule and ruled (allow or block), both null where no rule fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    for kind, host, path in reversed(ordered):
        on_host = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits = on_host & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return urls.select("*", rule.alias("rule"), verdict.alias("ruled"))


def digit_share(text: str) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1))


def entropy(text: str) -> Column:
    """Shannon entropy in bits of the characters among the URL alphabet, by each one's count."""
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#=&%+"
    lowered, total = F.lower(text), F.greatest(F.length(text), F.lit(1)).cast("double")

    def term(character: str) -> Column:
        share = (F.length(text) - F.length(F.replace(lowered, F.lit(character), F.lit("")))) / total
        return F.when(share > 0, -share * F.log2(share)).otherwise(0.0)

    return sum((term(c) for c in alphabet[1:]), term(alphabet[0]))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds suffix, domain and head (the path's first part), and the features that one URL gives."""
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    named = urls.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "domain": F.substring_index("host", ".", -2),
            "head": F.substring_index(F.substring("path", 2, 1 << 20), "/", 1),
            "url_length": F.length("url"),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
            "host_labels": F.size(F.split("host", "[.]")),
            "url_digits": digit_share("url"),
            "host_digits": digit_share("host"),
            "path_digits": digit_share("path"),
            "entropy": entropy("url"),
            "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
            "query_length": F.length(query),
            "hyphens": F.length("url") - F.length(F.replace(F.col("url"), F.lit("-"), F.lit(""))),
            "has_fragment": F.contains(F.col("url"), F.lit("#")).cast("int"),
            "is_https": F.lower("url").startswith("https://").cast("int"),
        }
    )
    return named.withColumns({f: F.col(f).cast("double") for f in FEATURES if f in named.columns})


def suffix_shares(labelled: DataFrame, column: str) -> DataFrame:
    """Rows of a suffix and its share of blocked URLs, for every suffix with MIN_SUFFIX_URLS labelled URLs."""
    counts = labelled.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share"))
    return counts.where(F.col("n") >= MIN_SUFFIX_URLS).select(column, F.col("share").alias(f"{column}_share"))


def table_bytes(table: DataFrame, column: str) -> int:
    return table.agg(F.sum(F.octet_length(column) + ROW_BYTES)).first()[0] or 0


def join_shares(urls: DataFrame, table: DataFrame, column: str, small: bool) -> DataFrame:
    """`urls` with the shares of their suffixes, null for unknown ones."""
    if small:
        return urls.join(F.broadcast(table), column, "left")
    dealt = urls.withColumn("_salt", F.pmod(F.xxhash64("url", "id"), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies.hint("merge"), [column, "_salt"], "left").drop("_salt")


@dataclass
class Trees:
    """Grown trees with the suffix statistics they use; or, without trees, the one probability there is."""

    model: GBTClassificationModel | None
    shares: dict[str, DataFrame]
    constant: float = 0.0
    #: Names of the tables that are broadcast.
    small: frozenset[str] = frozenset()

    def features(self, urls: DataFrame) -> DataFrame:
        for name, table in self.shares.items():
            urls = join_shares(urls, table, name, name in self.small).fillna(-1.0, [f"{name}_share"])
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(urls)

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds block_score to lexical() URLs."""
        if self.model is None:
            return urls.withColumn("block_score", F.lit(self.constant))
        scored = self.model.transform(self.features(urls))
        return scored.withColumn("block_score", vector_to_array("probability")[1])


def train(labelled: DataFrame) -> Trees:
    """Trees from lexical() URLs with `ruled`."""
    labelled = labelled.withColumn("label", (F.col("ruled") == "block").cast("double"))
    kinds = [row.label for row in labelled.groupBy("label").count().collect()]
    if len(kinds) < 2:
        return Trees(None, {}, kinds[0] if kinds else 0.0)
    trees = Trees(None, {name: cut(suffix_shares(labelled, name)) for name in ("suffix", "domain", "head")})
    trees.small = frozenset(name for name, table in trees.shares.items() if table_bytes(table, name) <= BROADCAST_BYTES)
    order = (F.xxhash64("url"), "id")
    # Sorted again, as the trees depend on the order of their rows and a shuffled join changes it.
    sample = trees.features(labelled.orderBy(*order).limit(TRAINING_URLS)).orderBy(*order).limit(TRAINING_URLS)
    grower = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=32)
    trees.model = grower.fit(sample.select("label", "features"))
    return trees


def judge(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """Per row of `pages`: id, host, path, rule, verdict, and block_score, the trees' probability of block."""
    urls = lexical(decided(split_urls(pages, id_column, url_column), rules))
    scored = train(urls.where("ruled IS NOT NULL")).score(urls)
    verdict = F.coalesce("ruled", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), "block_score")
