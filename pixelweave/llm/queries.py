"""One query for every operator: the given tables in the operators' columns, and results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import audit, chat, infill, line_dedup, mixing, neighbours, packing, secrets, sharding, simhash, topk, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.col("source").alias("node_type"), "text")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def public_tokenizer() -> dict[str, str]:
    import public_tokenizers as P

    return {"tokenizer": P.path("byte_bpe_50k.json"), "ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


@query
def op1_line_dedup(spark, sf):
    r = line_dedup.dedup_lines(texts(spark, sf))
    return r.select(F.col("node_id").alias("doc_id"), "text", "lines_removed")


@query
def op2_nearest_neighbours(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").alias("signature"))
    r = neighbours.nearest_images(e, e.filter("image_id % 50 = 0"), 5)
    return r.select("query_id", "rank", F.col("image_id").alias("vec_id"), "score")


@query
def op3_chat_format(spark, sf):
    kinds = "node_id long, seq long, kind string, turn long, role string, text string"
    c = table(spark, sf, "conversations")
    events = c.select(F.col("conv_id").alias("node_id"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "message", 0, "user", planted), (-7, 1, "message", 1, "assistant", planted)], kinds)
    # every row is a message of its own, also where turns repeat or are null (last, as in SQL)
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")).cast("long")
    runs = chat.format_chats(events.union(extra).withColumn("seq", place).withColumn("turn", F.col("seq")))
    turns, loss = chat.read_turns(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss"))
    runs = runs.select("node_id", "formatted", turns.alias("turns"), loss.alias("under"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return runs.select(F.col("node_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op4_best_fit_packing(spark, sf):
    r = packing.pack_texts(texts(spark, sf), **public_tokenizer())
    return r.withColumnRenamed("node_id", "doc_id")


@query
def op5_source_mix(spark, sf):
    r = mixing.mix_sources(texts(spark, sf))
    return r.select(F.col("node_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op6_simhash(spark, sf):
    return simhash.simhash_groups(texts(spark, sf)).withColumnRenamed("node_id", "doc_id")


@query
def op7_toxicity(spark, sf):
    t = texts(spark, sf).select("node_id", "text")
    labels = table(spark, sf, "labels").filter(~held_out("doc_id")).select(F.col("doc_id").alias("node_id"), "toxic")
    r = toxicity.score_toxicity(t, toxicity.fit_model(t, labels))
    return r.select(F.col("node_id").alias("doc_id"), held_out("node_id").alias("held_out"), "score", "predicted")


@query
def op8_secret_scan(spark, sf):
    r = secrets.find_secrets(texts(spark, sf))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return r.select(F.col("node_id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"))


@query
def op9_exact_topk(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    e = e.select("image_id", F.transform("v", lambda x: F.floor(x * 1024)).alias("levels"))
    r = topk.top_products(e, e.filter("image_id % 100 = 0"), 10)
    return r.select("query_id", "rank", F.col("image_id").alias("vec_id"), "score")


#: Rules that the query is given.
SITE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query
def op10_url_filter(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("node_id"), "url")
    r = url_filter.filter_links(p, [url_filter.site_rule(v, n) for v, n in SITE_RULES])
    return r.select(F.col("node_id").alias("page_id"), "host", "path", "rule", "verdict")


@query
def op11_filter_audit(spark, sf):
    t = texts(spark, sf).withColumn("node_type", F.coalesce("node_type", F.lit("")))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("node_id"), "quality", "toxic")
    return audit.audit_filters(t, labels).withColumnRenamed("node_type", "part")


@query
def op12_sharding(spark, sf):
    r = sharding.assign_shards(texts(spark, sf), 24)
    return r.select(F.col("node_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op13_fill_in_middle(spark, sf):
    r = infill.restore(infill.fill_in_middle(texts(spark, sf)))
    return r.select(F.col("node_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def _fits(rule: str) -> str:
    host, path = rule.split("/", 1)
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


_BY_LENGTH = sorted(SITE_RULES, key=lambda r: -len(r[1]))
_BLOCKED = "|".join(r.name.removeprefix("**.") for r in url_filter.FILE_RULES)
_CHARS = rf"(length({{0}}) + length({{0}}) - length(replace({{0}}, '\', '')) + len(regexp_extract_all({{0}}, '<\||</?s>|\[/?INST\]')))"
_MARKS = len(chat.START + chat.SEP + chat.END)

_BITS = ("CASE WHEN w < 200 THEN 1 ELSE 0 END + CASE WHEN 100*dw < 50*w THEN 2 ELSE 0 END + CASE WHEN 100*cap > 2*n THEN 4 ELSE 0 END "
         "+ CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END")
_KEYS = sharding.round_keys(1)


def _scramble(x: str) -> str:
    """``sharding.scramble`` of an unsigned 64-bit number."""
    step = lambda by, m: f"(xor(s, s >> {by}) * {m}::UBIGINT) & {sharding.WORD}::UBIGINT"
    e = f"list_transform([{x}], lambda s: {step(16, sharding.MIX[0])})"
    e = f"list_transform({e}, lambda s: {step(13, sharding.MIX[1])})"
    return f"list_transform({e}, lambda s: xor(s, s >> 16))[1]"


_PASS = "list_reduce([{l: v >> h, r: v & m}, " + ", ".join(f"{{l: {k}::UBIGINT, r: 0::UBIGINT}}" for k in _KEYS) + "], lambda a, k: {l: a.r, r: xor(a.l, " + _scramble(
    f"(a.r + k.l) & {sharding.WORD}::UBIGINT") + " & m)})"

#: DuckDB twins of the queries that SQL can say. The others need a tokenizer, XXH64, a trained model or positions of matches, or are approximate.
ORACLES = {
    "op1_line_dedup": (
        "WITH li AS MATERIALIZED (SELECT doc_id, line, pos, doc_id * 1048576 + pos AS no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
        "generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)), "
        "dl AS MATERIALIZED (SELECT line, no, s, len(s) AS n FROM (SELECT line, min(no) AS no, "
        rf"list_distinct(regexp_extract_all(translate(line, '{line_dedup.UPPER}', '{line_dedup.LOWER}'), '[^\x20\x09-\x0D]+')) AS s FROM li GROUP BY line) WHERE len(s) >= 5), "
        "tk AS MATERIALIZED (SELECT no, n, unnest(s) AS w FROM dl), df AS MATERIALIZED (SELECT w, count(*) AS c FROM tk GROUP BY w), "
        "pre AS MATERIALIZED (SELECT no, n, w FROM (SELECT no, n, w, row_number() OVER (PARTITION BY no ORDER BY c, w) AS k FROM tk JOIN df USING (w)) WHERE k <= n - (4 * n + 4) // 5 + 1), "
        "ca AS MATERIALIZED (SELECT DISTINCT a.no AS x, b.no AS y FROM pre a JOIN pre b ON a.w = b.w AND b.no < a.no AND 5 * b.n >= 4 * a.n AND 5 * a.n >= 4 * b.n), "
        "go AS (SELECT DISTINCT x FROM ca JOIN dl a ON a.no = x JOIN dl b ON b.no = y WHERE 9 * len(list_intersect(a.s, b.s)) >= 4 * (a.n + b.n)), "
        "ma AS (SELECT li.doc_id, pos, li.line, d.no IS NOT NULL AND (d.no <> li.no OR x IS NOT NULL) AS out FROM li LEFT JOIN dl d ON d.line = li.line LEFT JOIN go ON x = d.no), "
        "ag AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT out), '') AS text, (count(*) FILTER (out))::INTEGER AS lines_removed FROM ma GROUP BY doc_id) "
        "SELECT doc_id, ag.text, coalesce(lines_removed, 0) AS lines_removed FROM documents LEFT JOIN ag USING (doc_id)"),
    "op3_chat_format": (
        "WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations "
        "UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')), "
        "g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS t, "
        "coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS l, "
        f"sum({_MARKS} + {_CHARS.format('role')} + {_CHARS.format('text')})::BIGINT AS formatted_chars FROM c GROUP BY conv_id) "
        "SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g"),
    "op9_exact_topk": (
        "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS l FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) "
        "SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM "
        "(SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.l, c.l)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 10"),
    "op11_filter_audit": (
        r"WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents), "
        r"f AS MATERIALIZED (SELECT doc_id, part, t, length(t) AS n, len(l) AS w, len(list_distinct(l)) AS dw, n - length(regexp_replace(t, '[A-Z]', '', 'g')) AS cap, "
        r"min(doc_id) OVER (PARTITION BY t) AS first FROM (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d)), "
        "g AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS bad FROM labels GROUP BY doc_id), "
        f"c AS MATERIALIZED (SELECT part, {_BITS} AS b, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN g USING (doc_id) GROUP BY ALL), "
        "p AS (SELECT a || b || c || d || e AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t1(a), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t2(b), "
        "(VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t3(c), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t4(d), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t5(e) "
        "WHERE len(list_distinct([a, b, c, d, e])) = 5), "
        "s AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS letter, 1 << (instr('ABCDE', letter) - 1) AS own, "
        "list_sum(list_transform(range(1, step), lambda k: 1 << (instr('ABCDE', substr(filter_order, k, 1)) - 1)))::BIGINT AS earlier FROM p, range(1, 6) r(step)), "
        "x AS (SELECT part, filter_order, step, letter, sum(n) FILTER (b & (coalesce(earlier, 0) | own) = 0) AS kept, sum(n) FILTER (b & own <> 0 AND b & coalesce(earlier, 0) = 0) AS removed, "
        "sum(n) FILTER (b & own <> 0 AND b & coalesce(earlier, 0) <> 0) AS redundant, sum(n) FILTER (b = own) AS unique_fails, sum(good) FILTER (b & own <> 0 AND b & coalesce(earlier, 0) = 0) AS good_lost, "
        "sum(bad) FILTER (b & own <> 0 AND b & coalesce(earlier, 0) = 0) AS toxic_lost FROM c, s GROUP BY ALL) "
        "SELECT part, filter_order, step, " + ", ".join(f"coalesce({m}, 0)::BIGINT AS {m}" for m in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))
        + ", (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM x"),
    "op12_sharding": (
        "WITH RECURSIVE tb AS MATERIALIZED (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) t(i))), "
        "b AS MATERIALIZED (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS l FROM documents), "
        f"d AS MATERIALIZED (SELECT doc_id, len(l) + 8 AS size, xor(list_reduce(list_prepend({sharding.WORD}::UBIGINT, l), lambda c, x: xor(c >> 8, tb[((xor(c, x) & 255) + 1)::BIGINT])), {sharding.WORD}::UBIGINT)::BIGINT AS text_crc32, "
        "(row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1)::UBIGINT AS no FROM b, tb), "
        "k AS MATERIALIZED (SELECT n, greatest(1, (len(bin(n - 1)) + 1) // 2)::UBIGINT AS h, ((1::UBIGINT << h) - 1)::UBIGINT AS m FROM (SELECT count(*) AS n FROM documents)), "
        f"w(no, v, steps) AS (SELECT no, no, 0 FROM d UNION ALL SELECT no, (o.r << h) | o.l, steps + 1 FROM (SELECT no, steps, h, {_PASS} AS o FROM w, k WHERE steps = 0 OR v >= n)), "
        "z AS (SELECT no, v::BIGINT AS p FROM w, k WHERE steps > 0 AND v < n) "
        "SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 24)::INTEGER AS shard, p // 24 AS slot, NULL::INTEGER AS grown_shard FROM d JOIN z USING (no)"),
    "op13_fill_in_middle": (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(t) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents), "
        "c AS (SELECT *, " + ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4)) + " FROM d), "
        "p AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') "
        "OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c), "
        "s AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1, n - b) AS z FROM p) "
        "SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, "
        "sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"),
    "op10_url_filter": (
        f"WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, "
        "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), "
        "r AS (SELECT *, CASE " + " ".join(f"WHEN {_fits(n)} THEN '{n}'" for _, n in _BY_LENGTH) + " END AS rule FROM u) "
        "SELECT page_id, host, path, rule, CASE rule " + " ".join(f"WHEN '{n}' THEN '{v}'" for v, n in SITE_RULES)
        + f" ELSE CASE WHEN host = '' OR regexp_matches(path, '\\.({_BLOCKED})$') THEN 'block' ELSE 'allow' END END AS verdict FROM r"),
}
