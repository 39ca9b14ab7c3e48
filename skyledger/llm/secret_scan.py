"""Secrets in texts, judged by how many repositories and owners hold the same value.

Three kinds of candidates are found by pattern, leftmost and without overlap, and
located in code points. The values are hashed, and for every hash the distinct
repositories and owners are counted over the whole corpus. A value that many owners or
very many repositories have is a copied example, whoever copied it; so is one that looks like
a placeholder. Of the others, a value that a single owner has is taken for live, and one
that a few owners have is shared: it may be a team's credential. All of it is DataFrame code.

Defined cases: a null text has no candidate; a null owner or repository counts as one
owner or repository of its own; repeated rows are separate rows of the result but the
same repository; an empty table gives an empty result; columns of the input other than
the named ones are ignored here and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.llm.common import fresh, text_of, written

KINDS = ("assign", "access", "hex")
#: The pattern of each kind, the group that is the value, and its least length.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
VERDICTS = ("live", "example", "shared")  # kinds of the spans that the judgement adds
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_.-]|x{4}|0{8}|1234567|^(.)\1*$"
MASK = "[SECRET]"


def _occurrences(text: Column, kind: int) -> Column:
    """Matches of one kind, in order, each with the number of code points between it and the match before."""
    pattern, _, _ = PATTERNS[KINDS[kind]]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")),
                        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), x["g"].alias("gap"), x["m"].alias("match")))
    return F.when(text.rlike(pattern), pairs)


def _all_occurrences(text: Column) -> Column:
    none = F.expr("CAST(array() AS array<struct<kind:int,nth:int,gap:int,match:string>>)")
    return F.concat(*(F.coalesce(_occurrences(text, k), none) for k in range(len(KINDS))))


def _per_kind(kind: Column, of) -> Column:
    chosen = None
    for k, name in enumerate(KINDS):
        chosen = F.when(kind == k, of(name)) if chosen is None else chosen.when(kind == k, of(name))
    return chosen


def _value(kind: Column, match: Column) -> Column:
    return _per_kind(kind, lambda name: F.regexp_extract(match, PATTERNS[name][0], PATTERNS[name][1]))


def _located(found: DataFrame) -> DataFrame:
    """A row per candidate that is long enough: its span, and the span and hash of its value."""
    rows = found.where(F.size("occ") > 0).select("rid", "owner", "repo", F.inline("occ"))
    along = W.partitionBy("rid", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.length("match")).over(along))
    rows = rows.withColumn("value", _value(F.col("kind"), F.col("match")))
    rows = rows.where(F.length("value") >= _per_kind(F.col("kind"), lambda name: F.lit(PATTERNS[name][2])))
    return rows.select("rid", "owner", "repo", "kind", (F.col("end") - F.length("match")).alias("start"), "end",
                       (F.col("end") - F.length("value")).alias("value_start"),
                       F.sha2("value", 256).alias("hash"), F.col("value").rlike(PLACEHOLDER).alias("placeholder"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every value hash; each step shrinks before it shuffles."""
    repos = candidates.groupBy("hash", "owner", "repo").agg(F.max("placeholder").alias("placeholder"))
    owners = repos.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.max("placeholder").alias("placeholder"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.max("placeholder").alias("placeholder"))


def _judged(candidates: DataFrame, copied_owners: int, copied_repos: int, live_owners: int) -> DataFrame:
    """Candidates with ``verdict``: live, example or shared."""
    copied = (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos)
    verdict = (F.when(F.col("placeholder") | copied, F.lit("example"))
               .when(F.col("owners") <= live_owners, F.lit("live")).otherwise(F.lit("shared")))
    judged = ownership(candidates).select("hash", verdict.alias("verdict"), "owners", "repos")
    return candidates.drop("owner", "repo", "placeholder").join(judged, "hash")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", key: str = "doc_id",
         copied_owners: int = 3, copied_repos: int = 100, live_owners: int = 1) -> DataFrame:
    """One row per row of ``docs``: counts per kind, the spans, and what ownership says of them.

    A value of ``copied_owners`` or more owners, of ``copied_repos`` or more repositories, or one that
    looks like a placeholder, is an example; another of at most ``live_owners`` owners is live, the rest are shared.
    """
    light = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(repo).alias("repo"),
                        _all_occurrences(text_of(text)).alias("occ"))
    light = written(light, "secret-candidates")  # row numbers stay as they are from here on
    judged = _judged(_located(light), copied_owners, copied_repos, live_owners)
    name = _per_kind(F.col("kind"), F.lit)
    base = F.struct("start", F.col("kind"), "end", name.alias("name"))
    added = F.struct(F.col("value_start").alias("start"), (len(KINDS) + F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")).cast("int") - 1).alias("kind"), "end", F.col("verdict").alias("name"))
    per_row = judged.groupBy("rid").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        *(F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v}") for v in VERDICTS),
        F.collect_list(base).alias("base"), F.collect_set(added).alias("added"),
        F.max("owners").alias("most_owners"), F.max("repos").alias("most_repos"))
    counts = [f"n_{name}" for name in (*KINDS, *VERDICTS)]
    rows = light.select("rid", "key").join(per_row, "rid", "left")
    return rows.select(F.col("key").alias(key), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
                       F.sha2(F.coalesce(_joined(F.col("base")), F.lit("")), 256).alias("base_sha256"),
                       F.coalesce(_joined(F.concat("base", "added")), F.lit("")).alias("spans"),
                       F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"), F.coalesce("most_repos", F.lit(0)).cast("long").alias("most_repos"))


def _masked_kind(text: Column, live: Column, name: str) -> Column:
    pattern, group, least = PATTERNS[name]

    def put(match: Column) -> Column:
        value = F.regexp_extract(match, pattern, group)
        hit = (F.length(value) >= least) & F.array_contains(live, F.sha2(value, 256))
        return F.when(hit, F.concat(F.substring(match, F.lit(1), F.length(match) - F.length(value)), F.lit(MASK))).otherwise(match)

    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), put)
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda part, match: F.concat(part, F.coalesce(match, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id",
           copied_owners: int = 3, copied_repos: int = 100, live_owners: int = 1) -> DataFrame:
    """``docs`` with the live values masked; rows without a candidate pass untouched.

    Only rows with a candidate are written aside and joined, so the other texts never
    leave their task.
    """
    has = text_of(text).rlike("|".join(f"(?:{PATTERNS[k][0]})" for k in KINDS[1:])) | text_of(text).rlike(PATTERNS["assign"][0])
    rid, own, rep, occ, live = fresh([*docs.columns, "rid", "owner", "repo", "occ", "live"], "x_rid", "x_owner", "x_repo", "x_occ", "x_live")
    aside = docs.where(has).select("*", F.monotonically_increasing_id().alias(rid), F.col(owner).alias(own), F.col(repo).alias(rep),
                                   _all_occurrences(text_of(text)).alias(occ))
    aside = written(aside, "secret-rows")
    light = aside.select(F.col(rid).alias("rid"), F.col(own).alias("owner"), F.col(rep).alias("repo"), F.col(occ).alias("occ"))
    judged = _judged(_located(light), copied_owners, copied_repos, live_owners).where(F.col("verdict") == "live")
    hashes = judged.groupBy("rid").agg(F.collect_set("hash").alias(live)).withColumnRenamed("rid", rid)
    marked = aside.drop(own, rep, occ).join(hashes, rid, "left")
    for name in KINDS:  # a value inside one that is masked goes with it
        marked = marked.withColumn(text, F.when(F.col(live).isNotNull(), _masked_kind(F.col(text), F.col(live), name)).otherwise(F.col(text)))
    cleaned = marked.select(*docs.columns)
    return docs.where(~has).unionByName(cleaned)
