"""Stores, artifacts and their checks: probes, manifests, vectors, migrations, flattened results, CSV."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetry.operators import fingerprints as fp
from quillmetry.operators import ranks
from quillmetry.plans.catalog import query
from quillmetry.runtime import mounted, written
from quillmetry.sources import artifacts as art
from quillmetry.sources import files
from quillmetry.sources.tables import table


def _articles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "articles", ["id", *columns]).dropDuplicates(["id"])


@query("url_probe", "with a as (select distinct id, url, word_count from articles), s as (select distinct url from a where word_count % 2 = 0) select a.id, a.url in (select url from s where url is not null) as stored from a where a.word_count % 3 = 0 and a.url is not null")
def url_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incoming batch against the addresses in store: which are there already."""
    a = _articles(spark, sf_dir, "url", "word_count")
    stored = a.filter("word_count % 2 = 0").select("url").distinct().withColumn("stored", F.lit(True))
    return a.filter("word_count % 3 = 0 and url is not null").join(stored, "url", "left").select("id", F.coalesce("stored", F.lit(False)).alias("stored"))


@query("ordered_export", "select id, url, row_number() over (order by url, id) as place from (select distinct id, url from articles) a")
def ordered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their place in the order of export, ranked by ranges."""
    return ranks.ranked(_articles(spark, sf_dir, "url"), ["url", "id"], rank="place", total="_n").select("id", "url", "place")


CACHE_SQL = "case when doc_id % 7 = 0 then null when doc_id % 7 = 1 then 'v1' else 'v2' end"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of fingerprints of which some are old, missing or malformed."""
    made = fp.fingerprints(table(spark, sf_dir, "documents", ["doc_id", "text"]).filter("text is not null"), "doc_id", "text")
    stored = fp.to_hex(F.col("bands"))
    return made.select("doc_id", F.expr(CACHE_SQL).alias("version"), F.when(F.col("doc_id") % 11 == 3, F.lit("not-hex")).otherwise(stored).alias("fingerprint"))


@query("cached_fingerprints", f"select case when v is null or v <> 'v2' then 'stale' when doc_id % 11 = 3 then 'malformed' else 'current' end as state, count(*) as n from (select doc_id, {CACHE_SQL} as v from documents where text is not null) x group by 1")
def cached_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fingerprints by what they are good for; only current ones that parse are loaded."""
    bands = fp.from_hex(F.col("fingerprint"))
    state = F.when(F.coalesce(F.col("version") != "v2", F.lit(True)), "stale").when(bands.isNull(), "malformed").otherwise("current")
    return _cache(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("recomputed_fingerprints", f"select case when v is null or v <> 'v2' then 'recomputed' else 'kept' end as state, count(*) as n, count(*) as equal_to_text from (select doc_id, {CACHE_SQL} as v from documents where text is not null and doc_id % 11 <> 3) x group by 1")
def recomputed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale rows computed again from their texts, the others kept; the print of the text itself confirms both."""
    cache = _cache(spark, sf_dir).filter("doc_id % 11 <> 3")
    stale = F.coalesce(F.col("version") != "v2", F.lit(True))
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"]).filter("text is not null")
    fresh = fp.fingerprints(docs, "doc_id", "text").select("doc_id", "bands")
    renewed = cache.filter(stale).join(fresh, "doc_id").select("doc_id", F.lit("recomputed").alias("state"), "bands").unionByName(cache.filter(~stale).select("doc_id", F.lit("kept").alias("state"), fp.from_hex(F.col("fingerprint")).alias("bands")))
    return renewed.join(fresh.withColumnRenamed("bands", "own"), "doc_id").groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("bands") == F.col("own")).alias("equal_to_text"))


@query("audit_log", "select * from (values (1, 'first run', 'a1'), (2, 'second run', 'b2')) t(run, description, config_hash)")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended one by one to a log, read back whole."""
    path = files._path(spark, "audit")
    for row in ((1, "first run", "a1"), (2, "second run", "b2")):
        spark.createDataFrame([row], "run int, description string, config_hash string").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("schema_migrations", r"select distinct id, coalesce(nullif(regexp_extract(coalesce(url, ''), '^[a-z]+://[^/]+/([^/?#]+)/', 1), ''), 'unknown') as section, greatest(coalesce(word_count, 0), 0) as word_count, 3 as version from articles")
def schema_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of version 1 brought to 3 by numbered steps, and once more without any effect."""
    steps = {2: art.add_section, 3: lambda df: df.withColumn("word_count", F.greatest(F.coalesce("word_count", F.lit(0)), F.lit(0)).cast("long"))}
    df, version = art.migrate(_articles(spark, sf_dir, "url", "word_count"), 1, steps)
    df, version = art.migrate(df, version, steps)
    return df.select("id", "section", "word_count", F.lit(version).alias("version"))


@query("versioned_features", "select doc_id, lang, n_chars from documents")
def versioned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written with their schema's version and read through the gate, in order."""
    path = art.write_versioned(table(spark, sf_dir, "documents", ["doc_id", "lang", "n_chars"]), files._path(spark, "versioned"))
    return art.read_versioned(spark, path, ["n_chars", "doc_id"])


@query("entity_features", "select doc_id, n_chars from documents where source = 'wire-desk'")
def entity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity's rows, its filter pushed into the scan."""
    path = files.write_features(table(spark, sf_dir, "documents", ["doc_id", "source", "n_chars"]), "source")
    return art.read_entity(spark, path, "source", "wire-desk").select("doc_id", "n_chars")


@query("vector_round_trip", "select vec_id, len(embedding) as dim, list_sum(list_transform(embedding, lambda x: cast(x as double))) as total from embeddings where embedding is not null")
def vector_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors packed as binaries, stored, and unpacked through the gate of their dimension."""
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]).filter("embedding is not null")
    dim = e.select(F.size("embedding").alias("n")).first()
    stored = written(art.pack(e, "embedding").select("vec_id", "packed"), "vectors")
    return art.unpack(stored, "packed", dim.n if dim else 0).select("vec_id", F.size("vector").cast("long").alias("dim"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))


@query("vectors_by_source", "select source, revision, count(*) as n from (select case when label % 2 = 0 then 'main' else 'baseline' end as source, case when vec_id % 5 = 0 then 'old' else 'r1' end as revision, vec_id % 9 as cut from embeddings) x where revision = 'r1' and cut <> 4 group by 1, 2")
def vectors_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of vectors as one table, through the gates of dimension and revision."""
    e = table(spark, sf_dir, "embeddings")
    dim = e.select(F.size("embedding").alias("n")).first()
    n = dim.n if dim else 0
    vector = F.when(F.col("vec_id") % 9 == 4, F.slice("embedding", 1, n - 1)).otherwise(F.col("embedding"))
    shaped = e.select("vec_id", vector.alias("vector"), F.when(F.col("vec_id") % 5 == 0, "old").otherwise("r1").alias("revision"), "label")
    sources = [shaped.filter("label % 2 = 0").withColumn("source", F.lit("main")), shaped.filter("label % 2 <> 0").withColumn("source", F.lit("baseline"))]
    return art.load_vectors(sources, "vec_id", n, "r1").groupBy("source", "revision").agg(F.count("*").alias("n"))


@query("manifest_shards", "select doc_id, case when doc_id % 3 = 0 then 'new' else 'old' end as origin, case when doc_id % 3 = 0 then title end as title from documents")
def manifest_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a manifest with other columns as one; the last row of a key wins."""
    d = table(spark, sf_dir, "documents", ["doc_id", "title"]).withColumn("_line", F.col("doc_id"))
    old, new = d.select("doc_id", "_line", F.lit("old").alias("origin")), d.filter("doc_id % 3 = 0").select("doc_id", "_line", F.lit("new").alias("origin"), "title")
    return art.last_wins([old, new], "doc_id").select("doc_id", "origin", "title")


@query("manifest_rebuild", "select e.vec_id as doc_id, d.source, d.doc_id is not null as matched from (select distinct vec_id from embeddings) e left join (select distinct doc_id, source from documents) d on d.doc_id = e.vec_id")
def manifest_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest made again from the vectors in store and the documents' metadata."""
    return art.rebuild_manifest(table(spark, sf_dir, "embeddings", ["vec_id"]).withColumnRenamed("vec_id", "doc_id"), table(spark, sf_dir, "documents", ["doc_id", "source"]), "doc_id").select("doc_id", "source", "matched")


@query("author_manifest", "select slug, max(name) as name, count(*) as n from authors group by 1")
def author_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors as JSON lines, appended twice, read back with the last row of a slug."""
    authors = table(spark, sf_dir, "authors", ["id", "slug", "name"])
    path = files.write_jsonl(authors)
    files.write_jsonl(authors, path)
    back = files.read_jsonl(spark, path, authors.schema)
    return back.groupBy("slug").agg(F.max_by("name", "id").alias("name"), F.count_distinct("id").alias("n"))


@query("flattened_results", "select 'r' || cast(user_id as varchar) || '_result.json' as file, cast(user_id as varchar) as entity, '{\"n\":' || cast(n as varchar) || ',\"top\":' || cast(top as varchar) || '}' as summary from (select user_id, count(*) as n, max(event_id) as top from events group by 1) x")
def flattened_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file per entity as one table, parts as JSON text; a broken file is skipped."""
    e = table(spark, sf_dir, "events", ["user_id", "event_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("top"))
    folder = Path(mounted(files._path(spark, "results")))
    folder.mkdir(parents=True)

    def write(rows) -> None:
        for r in rows:
            art.write_artifact(folder / f"r{r.user_id}_result.json", {"entity": r.user_id, "summary": {"n": r.n, "top": r.top}})

    e.foreachPartition(write)
    (folder / "bad_result.json").write_text("{broken")
    return art.flatten_results(spark, f"file://{folder}/*_result.json", ["summary"])


@query("distance_matrix_csv", "with c as (select label, pos, avg(x) as m from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) e group by all), v as (select label, list(m order by pos) as v from c group by 1) select a.label as section, b.label as other, printf('%.6f', case when a.label = b.label then 0.0 else 1 - list_cosine_similarity(a.v, b.v) end) as distance from v a cross join v b")
def distance_matrix_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of sections as CSV of six decimals, a row per section, read back in long form."""
    e = table(spark, sf_dir, "embeddings", ["label", "embedding"])
    c = e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    size = c.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    dots = c.alias("a").join(c.alias("b"), "i").groupBy(F.col("a.label").alias("section"), F.col("b.label").alias("other")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("dot"))
    d = dots.join(size.select(F.col("label").alias("section"), F.col("len").alias("p")), "section").join(size.select(F.col("label").alias("other"), F.col("len").alias("q")), "other")
    d = d.withColumn("distance", F.format_string("%.6f", F.when(F.col("section") == F.col("other"), 0.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("dot", F.col("p") * F.col("q")))))))
    path = files._path(spark, "matrix")
    d.groupBy("section").pivot("other").agg(F.first("distance")).coalesce(1).write.option("header", True).csv(path)
    back = spark.read.option("header", True).csv(path)
    return back.unpivot("section", [x for x in back.columns if x != "section"], "other", "distance").select(F.col("section").cast("int"), F.col("other").cast("int"), "distance")


@query("excluded_csv", "select distinct a.id, a.author_id, case when a.clean_text is null or trim(a.clean_text) = '' then 'empty' when a.is_duplicate then 'duplicate' else 'short' end as reason, coalesce(au.is_shared_byline, false) = false as likely_own from articles a join authors au on au.id = a.author_id where a.clean_text is null or trim(a.clean_text) = '' or a.is_duplicate or a.word_count < 50")
def excluded_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles left out, with the reason and whether they are likely the author's own, as CSV with a fixed header."""
    a = _articles(spark, sf_dir, "author_id", "clean_text", "is_duplicate", "word_count")
    blank = F.col("clean_text").isNull() | (F.trim("clean_text") == "")
    reason = F.when(blank, "empty").when(F.col("is_duplicate"), "duplicate").when(F.col("word_count") < 50, "short")
    au = table(spark, sf_dir, "authors", ["id", "is_shared_byline"]).select(F.col("id").alias("author_id"), (~F.coalesce("is_shared_byline", F.lit(False))).alias("likely_own"))
    out = a.withColumn("reason", reason).filter("reason is not null").join(au, "author_id").select("id", "author_id", "reason", "likely_own")
    path = files._path(spark, "excluded")
    out.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(out.schema).csv(path)


@query("sufficient_body", r"select distinct id, case when len(regexp_extract_all(coalesce(clean_text, ''), '\S+')) = 0 then '' else md5(clean_text) end as body from articles")
def sufficient_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without a word become empty; the others stay (by their hash)."""
    n = F.size(F.regexp_extract_all(F.coalesce("clean_text", F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return _articles(spark, sf_dir, "clean_text").select("id", F.when(n == 0, "").otherwise(F.md5("clean_text")).alias("body"))


@query("resolved_authors", "select x.place, a.id, a.slug from (select * from (values (0, 'nobody-of-this-name'), (1, (select max(slug) from authors)), (2, (select min(slug) from authors))) t(place, slug)) x join authors a on a.slug = x.slug")
def resolved_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured slugs against stored authors, in the order of the configuration; unknown ones are dropped."""
    authors = table(spark, sf_dir, "authors", ["id", "slug"])
    ends = authors.agg(F.max("slug").alias("b"), F.min("slug").alias("c"))
    wanted = ends.select(F.posexplode(F.array(F.lit("nobody-of-this-name"), "b", "c")).alias("place", "slug"))
    return wanted.join(authors, "slug").select("place", "id", "slug").orderBy("place")


@query("custody", "with h as (select substr(sha256(string_agg(content_hash, '|' order by content_hash)), 1, 12) as digest from (select distinct id, content_hash from articles where coalesce(content_hash, '') <> '' and not is_duplicate) x) select digest as recorded, digest as found, true as intact from h union all select 'ffffffffffff', digest, false from h")
def custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded digests of the corpus against the digest it has now."""
    rows = _articles(spark, sf_dir, "content_hash", "is_duplicate").filter("coalesce(content_hash, '') <> '' and not is_duplicate")
    found = written(ranks.ordered_digest(rows, "content_hash").withColumnRenamed("digest", "found"), "digest")
    recorded = found.select(F.col("found").alias("recorded")).unionAll(spark.createDataFrame([("ffffffffffff",)], "recorded string"))
    return recorded.crossJoin(F.broadcast(found)).select("recorded", "found", (F.col("recorded") == F.col("found")).alias("intact"))


@query("stale_results", "select c.c_custkey, case when o.n is null then 'missing' when c.c_custkey % 5 = 0 then 'stale' else 'current' end as state from customer c left join (select o_custkey, count(*) as n from orders group by 1) o on o.o_custkey = c.c_custkey")
def stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose stored result was made under another configuration, or isn't there."""
    now, before = art.config_hash({"window": 90, "alpha": 0.05}), art.config_hash({"window": 60, "alpha": 0.05})
    results = table(spark, sf_dir, "orders", ["o_custkey"]).distinct().select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_custkey") % 5 == 0, before).otherwise(now).alias("config"))
    state = F.when(F.col("config").isNull(), "missing").when(F.col("config") != now, "stale").otherwise("current")
    return table(spark, sf_dir, "customer", ["c_custkey"]).join(results, "c_custkey", "left").select("c_custkey", state.alias("state"))


@query("decoded_numbers", "select event_id, case when json_valid(props) and props like '{%' then try_cast(json_extract_string(props, '$.k') as double) end as k from events")
def decoded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of JSON objects as maps of numbers; what isn't one is null."""
    return table(spark, sf_dir, "events", ["event_id", "props"]).select("event_id", F.try_element_at(art.decoded_numbers(F.col("props")), F.lit("k")).alias("k"))


@query("sampled_counts", "select author_id, 25 as n, true as known from (select distinct author_id from articles where word_count > 0) a")
def sampled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 word counts of each author drawn with replacement, the same for every run and every partitioning.

    The draws are hashes of author and number, taken as places among the author's counts in their order.
    """
    from pyspark.sql import Window

    a = _articles(spark, sf_dir, "author_id", "word_count").filter("word_count > 0")
    own = Window.partitionBy("author_id")
    placed = a.withColumns({"place": F.row_number().over(own.orderBy("word_count", "id")) - 1, "held": F.count("*").over(own)})
    draws = placed.select("author_id", "held").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(25)))).withColumn("place", F.pmod(F.xxhash64(F.lit(42), "author_id", "draw"), "held"))
    return draws.join(placed.select("author_id", "place", "word_count"), ["author_id", "place"]).groupBy("author_id").agg(F.count("*").cast("int").alias("n"), (F.count_if(F.col("word_count") > 0) == F.count("*")).alias("known"))


@query("round_robin", "with a as (select id, row_number() over (order by id) - 1 as i from (select distinct id from articles) x) select id, case i % 3 when 0 then 'economy' when 1 then 'politics' else 'culture' end as topic from a")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short list dealt round over all articles in their order."""
    topics = F.array(*[F.lit(t) for t in ("economy", "politics", "culture")])
    return ranks.ranked(_articles(spark, sf_dir), ["id"], rank="i", total="_n").select("id", F.element_at(topics, ((F.col("i") - 1) % 3 + 1).cast("int")).alias("topic"))
