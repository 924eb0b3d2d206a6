"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Base kinds are found by fixed patterns in each text. Beyond them, every token-like string (20 or more of
A-Za-z0-9+/_=-, with a digit and a letter), inside a base span or not, is a candidate. Candidates are hashed and
counted over the corpus by distinct repositories and distinct owners: a hash that at most MAX_OWNERS owners
and at most MAX_REPOS repositories hold is owner-specific and becomes a span of kind "owned" if it looks live (it names no
placeholder and has LIVE_CHARACTERS different characters or more); one that more
owners or more repositories hold, or that looks like no live one, is an example and is only counted. Exact copies of a text count
once, as of the least owner and repository that hold it: they are one origin, however often it was copied.

Rows: one per input row. A null text is an empty one. Repeated rows give repeated results; null ids are
kept. A null owner or repository counts as one owner or repository of its own. Empty tables give no rows. Only the named columns are read. Spans are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mwspark.llm.common import cut, table

# fixed values: the patterns of the base kinds, in their order
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the longest run of 16 or more: shorter matches would be dropped
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "owned")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change_?me|your_|xxxx"
LIVE_CHARACTERS = 10
MAX_OWNERS = 2
MAX_REPOS = 8
SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as structs of (start, kind, end, value).

    Positions are running sums of the lengths of gaps and matches: first over blocks of about the square root of
    their number, then within each block, so that no list grows long while it is appended to.
    """
    zero = F.lit(0).cast("long")

    def within(z: Column) -> Column:
        def add(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["gap"])
            end = start + F.length(x["hit"])
            return F.struct(F.concat(a["list"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("value")))).alias("list"), end.alias("at"))

        return F.aggregate(z["block"], F.struct(F.lit([]).cast(SPAN).alias("list"), z["before"].alias("at")), add, lambda a: a["list"])

    def of_blocks(blocks: Column) -> Column:
        long = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + F.length(x["gap"]) + F.length(x["hit"])))
        before = let(long, lambda n: F.aggregate(F.slice(n, F.lit(1), F.size(n) - 1), F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), before.alias("before")), within))

    def of_pairs(p: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(p))).cast("int")
        return let(F.transform(F.sequence(F.lit(1), F.size(p), step), lambda i: F.slice(p, i, step)), of_blocks)

    found = let(F.regexp_extract_all(text, _lit(pattern), F.lit(0)), lambda hit: let(F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hit)).alias("gap"), hit.alias("hit")), of_pairs))
    return F.when(text.rlike(pattern), found).otherwise(F.lit([]).cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(text: Column) -> Column:
    assign = F.filter(spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)
    return F.concat(assign, spans(text, ACCESS, 1), spans(text, HEX, 2))


def looks_live(value: Column) -> Column:
    return ~value.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)


def scan(docs: DataFrame, owner_col: str = "source", repo_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, text_key, base, owned (arrays of spans), n_example, n_repos (of the candidate in most repositories) for each row of docs.

    repo_col names the repository of a row; without one, each text is a repository of its own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text, F.lit(11)).alias("text_key"),
        F.col(owner_col).cast("string").alias("owner"),
        (F.col(repo_col).cast("string") if repo_col else F.xxhash64(text, F.lit(11)).cast("string")).alias("repo"),
        base_spans(text).alias("base"),
        F.filter(spans(text, CANDIDATE, 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")).alias("tokens"),
    )
    rows = cut(rows)  # a few spans a text: each text is matched once, whatever is read of it below
    # spans follow from the text, so equal texts share one list of candidates
    cand = rows.where(F.size("tokens") > 0).select("text_key", "owner", "repo", F.explode("tokens").alias("s")).withColumn("hash", F.xxhash64("s.value", F.lit(12)))
    origin = cand.groupBy("hash", "text_key").agg(F.min(F.struct("owner", "repo")).alias("o")).select("hash", "o.owner", "o.repo")
    by_owner = origin.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    by_repo = origin.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_repos"))
    freq = by_owner.join(by_repo, "hash")
    held = cand.groupBy("hash", "text_key", "s").agg(F.lit(1).alias("one")).join(freq, "hash")
    own = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos) & looks_live(F.col("s.value"))
    verdict = held.groupBy("text_key").agg(
        F.collect_list(F.when(own, F.col("s"))).alias("owned"),
        F.count(F.when(~own, 1)).alias("n_example"),
        F.max("n_repos").alias("n_repos"),
    )
    out = rows.select("doc_id", "text_key", "base").join(verdict, "text_key", "left")
    return out.select("doc_id", "text_key", "base", F.coalesce("owned", F.lit([]).cast(SPAN)).alias("owned"), F.coalesce("n_example", F.lit(0)).alias("n_example"), F.coalesce("n_repos", F.lit(0)).alias("n_repos"))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        _count(0).alias("n_assign"),
        _count(1).alias("n_access"),
        _count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "owned")).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"),
        F.col("n_example").cast("long").alias("n_example"),
    )


CHUNK = 1024  # code points


def _stretches(found: Column) -> Column:
    """Sorted spans as structs (start, before, new): before is how far earlier spans reach, new whether the span begins beyond that.

    Running maxima go over blocks of about the square root of their number, then within each block, so that no list grows long while it is appended to.
    """
    zero = F.lit(0).cast("long")
    kind = "array<struct<start:long,before:long,new:boolean>>"

    def within(z: Column) -> Column:
        def add(a: Column, x: Column) -> Column:
            one = F.struct(x["start"].alias("start"), a["at"].alias("before"), (x["start"] >= a["at"]).alias("new"))
            return F.struct(F.concat(a["list"], F.array(one)).alias("list"), F.greatest(a["at"], x["end"]).alias("at"))

        return F.aggregate(z["block"], F.struct(F.lit([]).cast(kind).alias("list"), z["before"].alias("at")), add, lambda a: a["list"])

    def of_blocks(blocks: Column) -> Column:
        far = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: x["end"])))
        before = let(far, lambda n: F.aggregate(F.slice(n, F.lit(1), F.size(n) - 1), F.array(zero), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x)))))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), before.alias("before")), within))

    def of_sorted(s: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(s))).cast("int")
        return let(F.transform(F.sequence(F.lit(1), F.size(s), step), lambda i: F.slice(s, i, step)), of_blocks)

    return let(F.sort_array(found), of_sorted)


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by mark; in time near linear in the text and the number of spans."""

    def cut_out(chunks: Column, a: Column, b: Column) -> Column:
        """Code points a to b, from the chunks that hold them."""
        first = F.floor(a / CHUNK).cast("int")
        some = F.slice(chunks, first + 1, F.greatest(F.floor((b - 1) / CHUNK).cast("int") - first + 1, F.lit(0)))
        return F.when(b > a, F.substring(F.array_join(some, ""), (a - first * CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def pieces(chunks: Column) -> Column:
        gaps = F.transform(F.filter(_stretches(found), lambda s: s["new"]), lambda s: cut_out(chunks, s["before"], s["start"]))
        end = F.array_max(F.transform(found, lambda s: s["end"]))
        return F.concat(gaps, F.array(cut_out(chunks, end, F.length(text).cast("long"))))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(found) > 0, F.array_join(let(chunks, pieces), mark)).otherwise(text)
