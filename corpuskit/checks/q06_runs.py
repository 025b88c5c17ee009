"""Sources, recipes, formulas, event logs and streams."""

import uuid

from pyspark.sql import functions as F

from corpuskit.checks import sqlparts as S
from corpuskit.checks.q02_text import pages_of
from corpuskit.checks.registry import register
from corpuskit.operators import search as SE
from corpuskit.plans import recipe as RC
from corpuskit.plans.formulas import with_formulas
from corpuskit.session import checkpoint_folder
from corpuskit.sources import corpus as SRC
from corpuskit.streaming import corpus as STC
from corpuskit.streaming import edits as E

# --- sources --------------------------------------------------------------------------------
@register("read_corpus")
def _(t):
    """The driver's own folder, read as files."""
    return SRC.read_corpus(t.spark, t.folder, ".PARQUET").select("file_id", "size")


_KIND = """CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'ole2' WHEN 3 THEN 'corrupt' ELSE 'other' END"""


def files(t):
    m, text = F.col("doc_id") % 5, F.col("text").cast("binary")
    content = (
        F.when(m == 0, F.concat(F.unhex(F.lit("0A0A255044462D")), text)).when(m == 1, F.concat(F.unhex(F.lit("504B0304")), text))
        .when(m == 2, F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), text)).when(m == 3, F.lit(b"")).otherwise(text)
    )
    return t.documents.select("doc_id", "n_chars", content.alias("content"))


@register("sniff_format", f"SELECT doc_id, {_KIND} AS kind FROM documents")
def _(t):
    return files(t).select("doc_id", SRC.sniff_format(F.col("content")).alias("kind"))


def _reason():
    kind = SRC.sniff_format(F.col("content"))
    return SRC.refuse_reason([
        (kind == "corrupt", "The file is empty or damaged."), (kind == "ole2", "The file is encrypted."),
        (~kind.isin("pdf", "zip"), "Files of this kind cannot be opened."), (F.col("n_chars") > 5000, "The file is too long."),
    ])


_WHY = f"""CASE WHEN doc_id % 5 = 3 THEN 'The file is empty or damaged.' WHEN doc_id % 5 = 2 THEN 'The file is encrypted.' WHEN doc_id % 5 = 4 THEN 'Files of this kind cannot be opened.'
  WHEN n_chars > 5000 THEN 'The file is too long.' END"""


@register("ingest_split_rejected", f"SELECT doc_id, {_WHY} AS reason FROM documents WHERE {_WHY} IS NOT NULL")
def _(t):
    return SRC.ingest_split(files(t), _reason())[1].select("doc_id", "reason")


@register("ingest_split_accepted", f"SELECT doc_id FROM documents WHERE {_WHY} IS NULL")
def _(t):
    return SRC.ingest_split(files(t), _reason())[0].select("doc_id")


@register("refuse_reasons", f"SELECT coalesce({_WHY}, 'ok') AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return files(t).groupBy(F.coalesce(_reason(), F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _fz(c):
    return f"""(SELECT CASE WHEN f1 < 0 OR f2 < 0 THEN 0 ELSE ((CASE WHEN f1 = 0 THEN 3 ELSE 1 END) + (CASE WHEN f1 = 0 OR substr(s, f1, 1) = ' ' THEN 2 ELSE 0 END)
      + (CASE WHEN f2 = f1 + 1 THEN 3 ELSE 1 END) + (CASE WHEN substr(s, f2, 1) = ' ' THEN 2 ELSE 0 END)) / sqrt(length(s)) END
      FROM (SELECT s, f1, CASE WHEN f1 >= 0 AND instr(substr(s, f1 + 2), 'r') > 0 THEN f1 + instr(substr(s, f1 + 2), 'r') ELSE -1 END AS f2 FROM (SELECT lower({c}) AS s, instr(lower({c}), 'b') - 1 AS f1)))"""


@register(
    "fuzzy_rank",
    f"WITH a AS (SELECT p_partkey, greatest({_fz('p_name')}, {_fz('p_brand')}) AS score FROM part) SELECT p_partkey, round(score, 6) AS score FROM a WHERE score > 0 ORDER BY a.score DESC, p_partkey LIMIT 50",
)
def _(t):
    ranked = SE.fuzzy_rank(t.part, ["p_name", "p_brand"], "br", "p_partkey", 50)
    return ranked.select("p_partkey", F.round("score", 6).alias("score"))


@register("recent_files", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 20")
def _(t):
    return SE.most_recent(t.events, "ts", "event_id", 20).select("event_id", "user_id")


# --- recipes and formulas -------------------------------------------------------------------
@register(
    "with_formulas",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice * (1 - l_discount) / 4 + -2.5, 6) AS quarter,
      CASE WHEN l_tax = 0 THEN NULL ELSE round(l_quantity / l_tax, 2) END AS ratio, CASE WHEN l_tax = 0 THEN 'The formula divides by zero.' END AS ratio_error,
      'The formulas refer to each other in a loop (a → b → a).' AS loop_error, 'Field "l_returnflag" is not a number ("' || l_returnflag || '").' AS text_error, 'There is no field named "nowhere".' AS unknown_error FROM lineitem""",
)
def _(t):
    out = with_formulas(SRC.spread(t.lineitem), {
        "quarter": "net / 4 + -2.5", "net": "[l_extendedprice] * (1 - l_discount)", "ratio": "l_quantity / l_tax",
        "a": "b + 1", "b": "a * 2", "word": "l_returnflag + 1", "lost": "nowhere + 1",
    })
    return out.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint"),
        F.round(F.col("net").cast("double"), 4).alias("net"), F.round(F.col("quarter").cast("double"), 6).alias("quarter"),
        F.round(F.col("ratio").cast("double"), 2).alias("ratio"), F.col("ratio__error").alias("ratio_error"),
        F.col("a__error").alias("loop_error"), F.col("word__error").alias("text_error"), F.col("lost__error").alias("unknown_error"),
    )


def recipe_docs(t):
    return t.documents.select(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file"), "text",
        F.octet_length("text").cast("bigint").alias("n_bytes"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("author"),
    )


def recipe_run(t):
    tools, settings = RC.parse_recipe({
        "tools": ["redact", "unheard-of", "metadata", "compress", "headerFooter"],
        "settings": {"compress": {"dpi": 150, "quality": 0.6}},
    })
    refused = F.when(F.col("doc_id") % 17 == 3, F.lit("The file could not be read."))
    docs = recipe_docs(t)
    recipe = RC.Recipe(tools, settings).register("stamp", lambda df, s: df.withColumn("file", F.concat(F.lit("x-"), "file")))
    return recipe.run(docs, refused)


_RUN = f"""{S.hits_sql('documents', 'doc_id')}, h AS (SELECT doc_id, count(*) AS n, sum(strlen(m)) AS b FROM hits GROUP BY doc_id),
  d AS (SELECT doc_id, doc_id % 17 = 3 AS bad, coalesce(n, 0) AS n, strlen(text) - coalesce(b, 0) AS nb, doc_id % 3 = 0 AS au FROM documents LEFT JOIN h USING (doc_id)),
  e AS (SELECT *, CAST(floor(greatest(1, 16.167 - 42.6025 * 0.6 + 43.6 * 0.36) * pow(nb, 0.6)) AS BIGINT) AS nw FROM d)"""


@register(
    "recipe_notes",
    f"""WITH {_RUN} SELECT 'failed' AS kind, 'The file could not be read.' AS detail, count(*) AS n FROM e WHERE bad UNION ALL SELECT 'changed', n || ' spans cut', count(*) FROM e WHERE NOT bad AND n > 0 GROUP BY n
    UNION ALL SELECT 'changed', 'unheard-of: unknown step, step left out', count(*) FROM e WHERE NOT bad
    UNION ALL SELECT 'metadata-scrubbed', 'author', count(*) FROM e WHERE NOT bad AND au UNION ALL SELECT 'kept-original', 'compress: estimate not smaller', count(*) FROM e WHERE NOT bad AND nw >= nb HAVING count(*) > 0
    UNION ALL SELECT 'changed', 'headerFooter: no settings, step left out', count(*) FROM e WHERE NOT bad""",
)
def _(t):
    return recipe_run(t)[1].groupBy("kind", "detail").agg(F.count(F.lit(1)).alias("n"))


@register("recipe_outputs", f"WITH {_RUN} SELECT d.doc_id, CASE WHEN bad THEN strlen(text) ELSE nb END::BIGINT AS n_bytes, CASE WHEN NOT bad THEN least(nw, nb) END::BIGINT AS n_bytes_estimate, bad AS failed FROM e d JOIN documents USING (doc_id)")
def _(t):
    return recipe_run(t)[0].select("doc_id", "n_bytes", "n_bytes_estimate", F.col("error").isNotNull().alias("failed"))


@register(
    "recipe_pages",
    f"""WITH {S.PAGES}, a AS (SELECT doc_id, page_no, text, count(*) OVER (PARTITION BY doc_id) AS n FROM pg),
    b AS (SELECT doc_id, (n + 3) // 4 * 4 AS total, n FROM a GROUP BY ALL),
    s AS (SELECT doc_id, n, total, generate_series AS slot, CASE WHEN (generate_series % 2 = 1) = (generate_series // 2 % 2 = 0) THEN generate_series // 2 ELSE total - 1 - generate_series // 2 END AS page_no FROM b, generate_series(0, total - 1)),
    h AS (SELECT doc_id, slot // 2 AS sheet, total // 2 AS sheets, string_agg(coalesce(text, ''), chr(10) ORDER BY slot) AS body FROM s LEFT JOIN a USING (doc_id, page_no) GROUP BY ALL)
    SELECT doc_id, sheet AS page_no, md5(CASE WHEN sheet BETWEEN 1 AND 2 THEN 'p ' || (sheet + 1) || ' of ' || sheets || chr(10) || body ELSE body END) AS text_md5 FROM h""",
)
def _(t):
    """Booklet sheets of whole documents, then a label on the second and third of them; no step is lost."""
    one = pages_of(t).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    docs = one.select(
        "doc_id", F.lit("x.pdf").alias("file"), F.array_join(F.transform("p", lambda x: x["text"]), RC.PAGE_BREAK).alias("text"),
        F.lit(0).cast("bigint").alias("n_bytes"),
    )
    recipe = RC.Recipe(["nup", "headerFooter"], {
        "nup": {"layout": "booklet"}, "headerFooter": {"headerText": "p {n} of {total}", "footerText": " ", "pageRange": "2-3"},
    })
    out = recipe.run(docs)[0]
    return out.select("doc_id", F.posexplode(F.split("text", RC.PAGE_BREAK, -1)).alias("page_no", "x")).select(
        "doc_id", F.col("page_no").cast("bigint").alias("page_no"), F.md5("x").alias("text_md5")
    )


@register(
    "keep_original_when_larger",
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'original' WHEN strlen(replace(text, 'the', 'a')) < strlen(text) THEN 'result' ELSE 'original' END AS choice,
      CASE WHEN doc_id % 11 = 0 THEN strlen(text) ELSE least(strlen(text), strlen(replace(text, 'the', 'a'))) END::BIGINT AS n_bytes FROM documents""",
)
def _(t):
    docs = recipe_docs(t)
    res = docs.filter("doc_id % 11 <> 0").withColumn("text", F.replace("text", F.lit("the"), F.lit("a"))).withColumn(
        "n_bytes", F.octet_length("text").cast("bigint")
    )
    return RC.keep_original_when_larger(docs, res)[0].select("doc_id", "choice", "n_bytes")


@register("batch_names_indexed", "SELECT c_custkey, lpad(CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR), CAST(length(CAST(count(*) OVER () AS VARCHAR)) AS INT), '0') || '_' || c_name AS out_name FROM customer")
def _(t):
    f = t.customer.select(F.col("c_custkey").alias("pos"), F.concat("c_name", F.lit(".pdf")).alias("name"))
    return RC.batch_names(f, "{index}_{basename}", "2024-05-06").select(F.col("pos").alias("c_custkey"), "out_name")


@register("custom_tool", "SELECT doc_id, 'x-doc' || doc_id || '.pdf' AS file FROM documents")
def _(t):
    recipe = RC.Recipe(["stamp"]).register("stamp", lambda df, s: df.withColumn("file", F.concat(F.lit("x-"), "file")))
    return recipe.run(recipe_docs(t))[0].select("doc_id", "file")


_BROKEN = "doc_id % 17 = 0"


def broken_every_17th(t):
    """A tool that raises on every 17th document, and one after it that fails by an expression on every 23rd."""
    def measured(doc, settings):
        if doc["doc_id"] % 17 == 0:
            raise ValueError("the page tree is broken")
        text = doc["text"] or ""
        return {"text": f"{text}|{len(text)}"}

    def stamp(df, settings):
        late = F.when(F.col("doc_id") % 23 == 0, F.lit("late")).otherwise(F.col("error"))
        return df.withColumns({"file": F.concat(F.lit("x-"), "file"), "error": late})

    recipe = RC.Recipe(["measure", "stamp"]).register("measure", RC.document_tool(measured, ["doc_id", "text"], ["text"])).register("stamp", stamp)
    return recipe.run(recipe_docs(t))


@register(
    "recipe_failures",
    f"""SELECT doc_id, 'failed' AS kind, CASE WHEN {_BROKEN} THEN 'ValueError: the page tree is broken' ELSE 'late' END AS detail FROM documents WHERE {_BROKEN} OR doc_id % 23 = 0""",
)
def _(t):
    return broken_every_17th(t)[1].select("doc_id", "kind", "detail")


@register(
    "recipe_outputs_after_failures",
    f"""WITH x AS (SELECT doc_id, {_BROKEN} AS broken, doc_id % 23 = 0 AS late, coalesce(text, '') AS t, text FROM documents)
    SELECT doc_id, broken OR late AS failed, CASE WHEN broken OR late THEN '' ELSE 'x-' END || 'doc' || doc_id || '.pdf' AS file, md5(CASE WHEN broken THEN text ELSE t || '|' || length(t) END) AS text_md5 FROM x""",
)
def _(t):
    return broken_every_17th(t)[0].select("doc_id", F.col("error").isNotNull().alias("failed"), "file", F.md5("text").alias("text_md5"))


# --- event logs -----------------------------------------------------------------------------
_SES = """a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > {gap} THEN 1 ELSE 0 END AS nw FROM events),
  b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)"""


def log(t):
    return t.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


@register("coalesce_edits", f"WITH {_SES.format(gap=7200000000)} SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS edits FROM b GROUP BY user_id, s")
def _(t):
    return E.coalesce_edits(log(t), "user_id", 7200).select(
        "user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "edits"
    )


@register("debounce", f"WITH {_SES.format(gap=3600000000)} SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM b GROUP BY user_id, s")
def _(t):
    return E.debounce(log(t), "user_id", 3600).select("user_id", "event_id")


_LIMIT = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
  r AS (SELECT user_id, min(us) AS us FROM e GROUP BY user_id UNION ALL SELECT r.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = r.user_id AND e.us >= r.us + 21600000000) AS us FROM r WHERE r.us IS NOT NULL)
  SELECT e.user_id, min(e.event_id) AS event_id FROM r JOIN e ON e.user_id = r.user_id AND e.us = r.us GROUP BY e.user_id, e.us"""


@register("rate_limit", _LIMIT)
def _(t):
    return E.rate_limit(log(t), "user_id", 21600).select("user_id", "event_id")


@register(
    "expire",
    """SELECT user_id, event_id FROM events a WHERE event_type IN ('view', 'click') AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = a.user_id AND p.ts >= a.ts AND epoch_us(p.ts) <= epoch_us(a.ts) + 21600000000)""",
)
def _(t):
    e = log(t)
    gone = E.expire(e.filter("event_type IN ('view', 'click')"), e.filter("event_type = 'purchase'"), "user_id", 21600)
    return gone.select("user_id", "event_id")


_HISTORY = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_id, user_id FROM r WHERE rn <= 5 ORDER BY ts DESC, event_id DESC LIMIT 200"""


@register("bounded_history", _HISTORY)
def _(t):
    return E.bounded_history(log(t), "user_id", 5, 200).select("event_id", "user_id")


@register("progress", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return E.progress(log(t).withColumnRenamed("event_type", "kind"))


def edit_log(t):
    op = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("do")
    return log(t).withColumn("op", op)


def edit_stream(t):
    op = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("do")
    return stream_of(t, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), op.alias("op"), "value")


_REPLAY = """WITH RECURSIVE e AS (SELECT user_id, event_type AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::DOUBLE[] AS d, []::DOUBLE[] AS u FROM events
    UNION ALL SELECT r.user_id, e.n,
      CASE WHEN t = 'error' THEN d[1:len(d) - 1] WHEN t = 'signup' THEN CASE WHEN len(u) > 0 THEN list_append(d, u[len(u)]) ELSE d END ELSE list_append(d, value) END,
      CASE WHEN t = 'error' THEN CASE WHEN len(d) > 0 THEN list_append(u, d[len(d)]) ELSE u END WHEN t = 'signup' THEN u[1:len(u) - 1] ELSE [] END
    FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
  SELECT user_id, d[len(d)] AS value, len(d) AS undo_depth, len(u) AS redo_depth FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1"""


@register("replay", _REPLAY)
def _(t):
    """Checked against a plain loop, and against its stream, in the tests."""
    return E.replay(edit_log(t), "user_id", None)


# --- streams over the same tables -------------------------------------------------------------
def stream_of(t, name):
    """The table's file, or all files of its folder; as a pattern, since a stream takes no single file."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/{name}[.]parquet")


def run_to_table(t, df, mode="append"):
    """Run a stream over what is there and give back what it wrote."""
    base = f"{checkpoint_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").start(
        f"{base}/out"
    ).awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{base}/out")


@register("stream_patterns", f"WITH {S.PAGES}, {S.hits_sql('pg', 'doc_id, page_no')} SELECT category, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY category")
def _(t):
    hits = run_to_table(t, STC.stream_patterns(stream_of(t, "documents").select("doc_id", "text")))
    return hits.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@register(
    "stream_index",
    f"WITH {S.PAGES}, p AS (SELECT doc_id, unnest(list_distinct({S.TOKENS})) AS token FROM pg WHERE doc_id % 17 <> 3) SELECT token, count(*) AS n_pages, count(DISTINCT doc_id) AS n_docs FROM p GROUP BY token",
)
def _(t):
    base = f"{checkpoint_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    docs = stream_of(t, "documents").select("doc_id", "text", (F.col("doc_id") % 17 != 3).alias("readable"))
    STC.stream_index(docs, f"{base}/index", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return STC.read_stream_index(t.spark, f"{base}/index").groupBy("token").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_distinct("doc_id").alias("n_docs")
    )


def event_stream(t, keep="true"):
    e = stream_of(t, "events").filter(keep)
    return e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")


def complete(t, df):
    """The whole result of a stream that has read all there is."""
    base = f"{checkpoint_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    df.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out")
    ).start().awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{base}/out")


@register("coalesce_edits_stream", f"WITH {_SES.format(gap=7200000000)} SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS edits FROM b GROUP BY user_id, s")
def _(t):
    out = complete(t, E.coalesce_edits_stream(event_stream(t), "user_id", "2 hours"))
    return out.select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "edits")


@register("debounce_stream", f"WITH {_SES.format(gap=3600000000)} SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM b GROUP BY user_id, s")
def _(t):
    return complete(t, E.debounce_stream(event_stream(t), "user_id", "1 hour")).select("user_id", "event_id")


@register("expire_stream", """SELECT user_id, event_id FROM events a WHERE event_type IN ('view', 'click') AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = a.user_id AND p.ts >= a.ts AND epoch_us(p.ts) <= epoch_us(a.ts) + 21600000000)""")
def _(t):
    """A far later event of each side, of a user nobody is, lets all waiting ends pass."""
    base = f"{checkpoint_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    e = log(t)
    late = e.limit(1).withColumns({"ts": F.col("ts") + F.expr("interval 100 years"), "user_id": F.lit(-1).cast("bigint")})
    both = e.unionByName(late.withColumn("event_type", F.lit("view"))).unionByName(late.withColumn("event_type", F.lit("purchase")))
    both.write.parquet(f"{base}/in")

    def side(kinds):
        return t.spark.readStream.schema(both.schema).parquet(f"{base}/in").filter(F.col("event_type").isin(*kinds))

    gone = E.expire_stream(side(["view", "click"]), side(["purchase"]), "user_id", "6 hours")
    return run_to_table(t, gone).filter("user_id >= 0").select("user_id", "event_id")


@register("rate_limit_stream", _LIMIT)
def _(t):
    e = stream_of(t, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return run_to_table(t, E.rate_limit_stream(e, "user_id", 21600)).select("user_id", "event_id")


@register("bounded_history_stream", _HISTORY)
def _(t):
    """The same entries from a stream: keyed state, and a store of 200 rows merged batch by batch."""
    base = f"{checkpoint_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    seen = [0]
    e = stream_of(t, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))

    def merge(batch, number):
        E.merge_history(batch, number, f"{base}/store", "user_id", 200)
        seen[0] = number

    E.bounded_history_stream(e, "user_id", 5).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(
        availableNow=True
    ).foreachBatch(merge).start().awaitTermination()
    return E.history_of(t.spark, f"{base}/store", seen[0], dict(e.dtypes)["user_id"], "user_id").select("event_id", "user_id")


@register("replay_stream", _REPLAY)
def _(t):
    """The newest state of each user from a stream; equals ``replay`` in the tests."""
    base = f"{checkpoint_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    e = edit_stream(t)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={number}")

    states = E.replay_stream(e, "user_id", None)
    states.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(
        write
    ).start().awaitTermination()
    newest = F.max_by(F.struct(*states.columns), "batch_id").alias("s")
    return t.spark.read.parquet(f"{base}/out").groupBy("user_id").agg(newest).select("s.*")


@register("stream_progress", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def _(t):
    """Running totals in update mode; the newest total of each kind is the largest."""
    base = f"{checkpoint_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    totals = E.progress(stream_of(t, "events").withColumnRenamed("event_type", "kind"))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={number}")

    totals.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(
        write
    ).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("kind").agg(F.max("n").alias("n"))
