"""Registered queries: sequences, enrichment, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compose, enrich, neighborhood
from ..operators import color
from ..operators import sequence as sq
from ..operators import stats
from ..schema import PIXEL, ensure_checkpoint_dir, images_of
from ..streaming import streams
from . import fixtures as fx
from . import sqlkit as K
from .catalog_raster import HIST, OUT, blur_sql
from .registry import query

FR, SQ = K.FRAMES, K.SEQ
_N = "nn AS (SELECT image_id, count(*)::INTEGER AS n FROM fr GROUP BY image_id)"


def fr(s, sf):
    return fx.seq_frames(s, sf)


# ---- Q -------------------------------------------------------------------------------------
query("Q1_resample_frames", K.sql(
    f"SELECT image_id, i::INTEGER AS frame, CASE WHEN n <= 12 THEN i ELSE least(n-1, {K.jsr('i*n/12e0')}) END::INTEGER AS src FROM nn, range(12) t(i) WHERE i < n", FR, _N))(
    lambda s, sf: sq.resample_frames(fr(s, sf), 12))
query("Q2_ping_pong", K.sql(
    "SELECT image_id, frame, frame AS src FROM fr UNION ALL SELECT image_id, (2*n-2-frame)::INTEGER, frame FROM fr JOIN nn USING (image_id) WHERE frame > 0 AND frame < n-1 AND n >= 3", FR, _N))(
    lambda s, sf: sq.ping_pong(fr(s, sf)))
query("Q3_repeat_frames", K.sql("SELECT image_id, (k*n+frame)::INTEGER AS frame, frame AS src FROM fr JOIN nn USING (image_id), range(3) t(k)", FR, _N))(
    lambda s, sf: sq.repeat_frames(fr(s, sf), 3.7))
query("Q4_reverse_frames", K.sql("SELECT image_id, (n-1-frame)::INTEGER AS frame, frame AS src FROM fr JOIN nn USING (image_id)", FR, _N))(
    lambda s, sf: sq.reverse_frames(fr(s, sf)))
_SHAPE = (
    f"s1 AS (SELECT image_id, n, i, CASE WHEN n <= 9 THEN i ELSE least(n-1, {K.jsr('i*n/9e0')}) END AS src FROM nn, range(9) t(i) WHERE i < n), "
    "s2 AS (SELECT image_id, least(n, 9) AS m, least(n, 9)-1-i AS i, src FROM s1), "
    "s3 AS (SELECT image_id, m, i, src FROM s2 UNION ALL SELECT image_id, m, 2*m-2-i, src FROM s2 WHERE m >= 3 AND i > 0 AND i < m-1), "
    "ix AS (SELECT image_id, (k*(CASE WHEN m >= 3 THEN 2*m-2 ELSE m END)+i)::INTEGER AS frame, src::INTEGER AS src FROM s3, range(2) t(k))"
)
_SHAPE_KW = dict(frame_count=9, loop="pingpong", cycles=2, reverse=True)
query("Q5_shape_sequence", K.sql("SELECT s.image_id, ix.frame, s.x, s.y, s.r, s.g, s.b, s.a FROM sq s JOIN ix ON ix.image_id=s.image_id AND ix.src=s.frame", FR, _N, SQ, _SHAPE))(
    lambda s, sf: sq.shape_sequence(fx.seq_pixels(fr(s, sf)), fr(s, sf), **_SHAPE_KW)[0].select(*OUT))
query("Q5_shape_delays", K.sql("SELECT f.image_id, ix.frame, f.delay_ms FROM fr f JOIN ix ON ix.image_id=f.image_id AND ix.src=f.frame", FR, _N, _SHAPE))(
    lambda s, sf: sq.shape_sequence(fx.seq_pixels(fr(s, sf)), fr(s, sf), **_SHAPE_KW)[1])
for _k, _tag in ((-2, "_from_end"), (7, "")):
    _at = f"greatest(0, least(n-1, {'n' if _k < 0 else '0'}+({_k})))"
    query(f"Q6_frame_select{_tag}", K.sql(f"SELECT {K.OUT} FROM sq JOIN nn USING (image_id) WHERE frame = {_at}", FR, _N, SQ))(
        lambda s, sf, k=_k: sq.frame_select(fx.seq_pixels(fr(s, sf)), k).select(*OUT))
query("Q7_frames_per_lens", (
    "SELECT DISTINCT l_linenumber, l_quantity, CASE WHEN l_linenumber > 2 AND l_quantity > 5 THEN floor(l_quantity*20/((l_linenumber-2)*10e0)/greatest(1, l_linenumber-3))::INTEGER ELSE 0 END AS n FROM lineitem"))(
    lambda s, sf: fx.table(s, sf, "lineitem").select("l_linenumber", "l_quantity").distinct().select(
        "l_linenumber", "l_quantity", sq.frames_per_lens(F.when(F.col("l_quantity") > 5, F.col("l_quantity") * 20).otherwise(F.lit(0.0)),
                                                          (F.col("l_linenumber") - 2) * 10.0, F.col("l_linenumber") - 3).alias("n")))
query("Q8_map_frames", K.sql(f"SELECT {K.OUT} FROM bl", FR, SQ, blur_sql("sq", "bl", 1)))(
    lambda s, sf: sq.map_frames(fx.seq_pixels(fr(s, sf)), lambda p: neighborhood.box_blur(p, 1)).select(*OUT))


def timing_inputs(s, sf):
    """Three inputs per sequence: the whole one (with a hole for odd users), its first half, its first five frames."""
    f = fr(s, sf).join(sq.lengths(fr(s, sf)), "image_id")
    hole = (F.col("image_id") % 2 == 1) & (F.col("frame") == 3)
    a = f.select("image_id", F.lit(0).alias("input"), "frame", F.when(~hole, F.col("delay_ms")).alias("delay_ms"))
    b = f.filter("frame < n div 2").select("image_id", F.lit(1).alias("input"), "frame", (F.col("delay_ms") + 1).alias("delay_ms"))
    d = f.filter("frame < 5").select("image_id", F.lit(2).alias("input"), "frame", (F.col("delay_ms") + 2).alias("delay_ms"))
    return a.union(b).union(d)


_TI = ("ti AS (SELECT image_id, 0 AS input, frame, CASE WHEN image_id%2=1 AND frame=3 THEN NULL ELSE delay_ms END AS delay_ms FROM fr UNION ALL "
       "SELECT image_id, 1, frame, delay_ms+1 FROM fr JOIN nn USING (image_id) WHERE frame < n//2 UNION ALL SELECT image_id, 2, frame, delay_ms+2 FROM fr WHERE frame < 5)")
query("Q9_carry_timing", K.sql(
    "SELECT t.image_id, t.frame, t.delay_ms::INTEGER AS delay_ms FROM ti t JOIN (SELECT image_id, input, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, input) AS k FROM pr WHERE full_) b "
    "ON b.image_id=t.image_id AND b.input=t.input AND k=1 WHERE t.image_id % 5 <> 0", FR, _N, _TI,
    "pr AS (SELECT image_id, input, count(*) AS n, count(delay_ms)=count(*) AS full_ FROM ti GROUP BY ALL)"))(
    lambda s, sf: sq.carry_timing(timing_inputs(s, sf), fr(s, sf).filter("image_id % 5 <> 0 or frame > 0").select("image_id", "frame")))
query("Q10_first_frame_scalars", K.sql(
    f"SELECT image_id, sum(CASE WHEN {K.lum()}/255e0 >= 0.5e0 THEN 1 ELSE 0 END)::BIGINT AS n_on, count(*) AS n FROM sq WHERE frame=0 GROUP BY image_id", FR, SQ))(
    lambda s, sf: sq.first_frame_scalars(stats.coverage(fx.seq_pixels(fr(s, sf))).select("image_id", "frame", "n_on", "n")))
query("Q11_to_images", K.sql(
    f"SELECT {K.OUT} FROM sq UNION ALL SELECT image_id, (n+frame)::INTEGER, x, y, 255-r, 255-g, 255-b, a FROM sq JOIN nn USING (image_id) WHERE frame < 3 UNION ALL "
    "SELECT image_id, (n+least(n,3))::INTEGER, x, y, r, g, b, a FROM sq JOIN nn USING (image_id) WHERE frame=0", FR, _N, SQ))(
    lambda s, sf: (lambda p: sq.to_images([p, color.invert(p.filter("frame < 3")), sq.to_image(p)]))(fx.seq_pixels(fr(s, sf))).select(*OUT))
query("A10_sequence_summary", K.sql(
    "SELECT image_id, count(*) AS n_frames, sum(delay_ms)::BIGINT AS total_ms, 4 AS w, 4 AS h, 32 AS lens_frames, count(*) <= 32 AS fits FROM fr GROUP BY image_id", FR))(
    lambda s, sf: sq.sequence_summary(fr(s, sf), images_of(fx.seq_pixels(fr(s, sf))), 1440, 45))
_STILL = "stl AS (SELECT image_id, x, y, r, g, b, a FROM sq WHERE frame=1)"
query("J11_broadcast_still", K.sql(
    "SELECT p.image_id, p.frame, p.x, p.y, " + ", ".join(f"coalesce({K.u8(f'255e0-(255e0-p.{c})*(255e0-q.{c})/255e0')}, p.{c}) AS {c}" for c in "rgb")
    + ", greatest(p.a, q.a) AS a FROM sq p LEFT JOIN stl q USING (image_id, x, y)", FR, SQ, _STILL))(
    lambda s, sf: (lambda p: compose.broadcast_still(p, p.filter("frame = 1"), "screen"))(fx.seq_pixels(fr(s, sf))).select(*OUT))
query("J12_hold_last_join", K.sql(
    "SELECT image_id, frame, x, y, " + ", ".join(f"{K.u8(f'abs(p.{c}-q.{c})')} AS {c}" for c in "rgb") + ", greatest(p.a, q.a) AS a FROM sq p JOIN "
    "(SELECT n.image_id, f::INTEGER AS frame, s.x, s.y, s.r, s.g, s.b, s.a FROM (SELECT * FROM nn, range(nn.n) t(f)) n JOIN sq s ON s.image_id=n.image_id AND s.frame=least(f, greatest(1, n.n//3)-1)) q "
    "USING (image_id, frame, x, y)", FR, _N, SQ))(
    lambda s, sf: (lambda f: compose.hold_last_join(
        fx.seq_pixels(f), fx.seq_pixels(f.join(sq.lengths(f), "image_id").filter("frame < greatest(1, n div 3)")), "difference", same_size=True).select(*OUT))(fr(s, sf)))


# ---- E -------------------------------------------------------------------------------------
def raw_requests(s, sf):
    """one request row per document; every second one has a seed."""
    k = F.col("doc_id")
    return fx.table(s, sf, "documents").select(
        k.alias("request_id"), F.when(k % 3 != 0, F.col("text")).otherwise(F.lit("")).alias("wired"),
        F.when(k % 6 != 0, F.concat(F.lit("inline "), F.col("source"))).alias("inline"), F.col("lang"),
        F.when(k % 4 == 1, F.lit("")).otherwise((k % 7 / 2).cast("string")).alias("steps"), (k % 5 == 0).alias("flag"),
        F.when(k % 11 == 3, F.lit("{oops")).when(k % 10 == 4, F.lit("[true,null]"))
        .when(k % 2 == 0, F.concat(F.lit('{"seed":'), k % 50, F.lit(',"a":{"z":1,"b":[2,"x"]},"lang":"over"}'))).otherwise(F.lit("  ")).alias("extra"),
    )


_RAW = ("rq AS (SELECT doc_id AS request_id, CASE WHEN doc_id%3<>0 THEN text ELSE '' END AS wired, CASE WHEN doc_id%6<>0 THEN 'inline ' || source END AS inl, lang, "
        "CASE WHEN doc_id%4=1 THEN '' ELSE CASE WHEN (doc_id%7)%2=0 THEN (doc_id%7//2)::VARCHAR ELSE (doc_id%7//2)::VARCHAR || '.5' END END AS steps, doc_id%5=0 AS flag, "
        "CASE WHEN doc_id%11=3 THEN 'bad' WHEN doc_id%10=4 THEN 'list' WHEN doc_id%2=0 THEN 'obj' ELSE 'none' END AS ex, doc_id%50 AS seed FROM documents), "
        "rt AS (SELECT *, coalesce(nullif(wired, ''), inl, '') AS txt FROM rq), "
        "bq AS (SELECT request_id, CASE WHEN txt='' THEN 'missing prompt' WHEN ex='bad' THEN 'extra is not JSON' END AS error, ex, txt, "
        "'{' || concat_ws(',', CASE WHEN ex='list' THEN '\"0\":true' END, CASE WHEN ex='list' THEN '\"1\":null' END, CASE WHEN ex='obj' THEN '\"a\":{\"b\":[2,\"x\"],\"z\":1}' END, "
        "'\"flag\":' || flag::VARCHAR, '\"lang\":' || CASE WHEN ex='obj' THEN '\"over\"' ELSE to_json(lang)::VARCHAR END, '\"prompt\":' || to_json(txt)::VARCHAR, "
        "CASE WHEN ex='obj' THEN '\"seed\":' || seed END, CASE WHEN steps<>'' THEN '\"steps\":' || steps END) || '}' AS body FROM rt), "
        "rb AS (SELECT request_id, error, CASE WHEN error IS NULL THEN body END AS request, ex FROM bq)")


def built(s, sf):
    return enrich.build_request(raw_requests(s, sf), [("prompt", "wired", "inline", True)],
                                [("lang", "lang", "text"), ("steps", "steps", "number"), ("flag", "flag", "boolean")], "extra")


query("E3_build_request", K.sql("SELECT request_id, error, request FROM rb", _RAW))(lambda s, sf: built(s, sf).select("request_id", "error", "request"))
query("E1_canonical_request", (
    "SELECT doc_id, '{\"a\":{\"n\":' || n_chars || ',\"s\":' || to_json(source)::VARCHAR || '},\"lang\":' || to_json(lang)::VARCHAR || ',\"prompt\":' || to_json(text)::VARCHAR || '}' AS canon FROM documents"))(
    lambda s, sf: fx.table(s, sf, "documents").select("doc_id", enrich.canonical_request(F.to_json(F.struct(
        F.col("text").alias("prompt"), "lang", F.struct(F.col("source").alias("s"), F.col("n_chars").alias("n")).alias("a")))).alias("canon")))
query("E2_request_key", K.sql("SELECT request_id, sha256('m/one|' || request) AS key FROM rb WHERE request IS NOT NULL", _RAW))(
    lambda s, sf: built(s, sf).filter("request is not null").select("request_id", enrich.request_key(F.lit("m/one"), "request").alias("key")))
query("E4_size_guard", (
    "SELECT doc_id, bytes, bytes > 2000 AS too_large FROM (SELECT doc_id, floor((length(t) - instr(t, ','))*0.75e0)::BIGINT AS bytes FROM "
    "(SELECT doc_id, CASE WHEN doc_id%4=0 THEN replace(text, ',', '') ELSE 'data:x;base64,' || text END AS t FROM documents))"))(
    lambda s, sf: enrich.size_guard(fx.table(s, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("text", ",", "")).otherwise(
        F.concat(F.lit("data:x;base64,"), "text")).alias("t")), "t", 2000).select("doc_id", "bytes", "too_large"))


def cache_table(s, sf):
    """Answers already known: the requests of every labelled document."""
    known = fx.table(s, sf, "labels").select(F.col("doc_id").alias("request_id"))
    r = built(s, sf).filter("request is not null").join(known, "request_id", "left_semi")
    return r.select(enrich.request_key(F.lit("m/one"), "request").alias("key")).distinct().withColumn("answer", F.concat(F.lit("cached "), F.substring("key", 1, 8)))


_SPLIT = ("ky AS (SELECT *, sha256('m/one|' || request) AS key, ex='obj' AS cacheable FROM rb WHERE request IS NOT NULL), "
          "ch AS (SELECT DISTINCT key, 'cached ' || substr(key, 1, 8) AS answer FROM ky WHERE request_id IN (SELECT doc_id FROM labels)), "
          "ms AS (SELECT min(request_id) AS request_id, key, any_value(request) AS request FROM ky WHERE cacheable AND key NOT IN (SELECT key FROM ch) GROUP BY key "
          "UNION ALL SELECT request_id, NULL, request FROM ky WHERE NOT cacheable)")


def _split(s, sf):
    return enrich.split_cache(built(s, sf).filter("request is not null").select("request_id", "request"), cache_table(s, sf), "m/one")


query("E5_cache_hits", K.sql("SELECT request_id, key, answer FROM ky JOIN ch USING (key) WHERE cacheable", _RAW, _SPLIT))(lambda s, sf: _split(s, sf)[0])


@query("E5_bucketed_cache", K.sql("SELECT request_id, key, answer FROM ky JOIN ch USING (key) WHERE cacheable", _RAW, _SPLIT))
def _from_buckets(s, sf):
    """The answers kept in a bucketed folder, in two batches, and asked for again."""
    path, known = f"{scratch(s)}/answers", cache_table(s, sf)
    for half in (0, 1):
        enrich.append_cache(known.filter(F.pmod(F.crc32("key"), F.lit(2)) == half), path, 8)
    return enrich.split_cache(built(s, sf).filter("request is not null").select("request_id", "request"), enrich.open_cache(s, path), "m/one")[0]


query("E5_cache_misses", K.sql("SELECT request_id, key, request FROM ms", _RAW, _SPLIT))(lambda s, sf: _split(s, sf)[1])


def answers(s, sf):
    """model answers of five shapes built from the events."""
    k = F.col("event_id")
    url = F.concat(F.lit("https://h/"), k, F.lit(".png"))
    q = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    return fx.table(s, sf, "events").select(
        "event_id",
        F.when(k % 6 == 0, q(url)).when(k % 6 == 1, F.concat(F.lit('[3,"'), "event_type", F.lit('","-'), k, F.lit('"]')))
        .when(k % 6 == 2, F.concat(F.lit('{"n":1,"note":"first","caption":"c'), k, F.lit('","mask":'), q(url), F.lit("}")))
        .when(k % 6 == 3, F.concat(F.lit('{"n":1,"meta":{"x":[{"url":'), q(url), F.lit('}]},"zz":null}')))
        .when(k % 6 == 4, F.concat(F.lit('{"output":'), "props", F.lit("}"))).otherwise(F.lit("not json")).alias("answer"),
    )


query("E6_resolve_outputs", (
    "SELECT event_id, CASE event_id%6 WHEN 0 THEN 'https://h/' || event_id || '.png' WHEN 1 THEN event_type || '-' || event_id WHEN 2 THEN 'c' || event_id END AS text, "
    "CASE event_id%6 WHEN 0 THEN 'https://h/' || event_id || '.png' WHEN 1 THEN event_type WHEN 2 THEN 'https://h/' || event_id || '.png' WHEN 3 THEN 'https://h/' || event_id || '.png' END AS url FROM events"))(
    lambda s, sf: enrich.resolve_outputs(enrich.resolve_outputs(answers(s, sf), "answer", "text", "text"), "answer", "url", "url").select("event_id", "text", "url"))
query("E7_chat_requests", (
    "SELECT conv_id, turn, CASE WHEN role='user' THEN 'system|Be brief.' ELSE '' END || '#' || 'user|' || concat_ws(chr(10)||chr(10), nullif(CASE WHEN turn%2=0 THEN 'Summarise:' ELSE '' END, ''), nullif(text, '')) AS flat FROM conversations "
    "WHERE concat_ws('', nullif(CASE WHEN turn%2=0 THEN 'Summarise:' ELSE '' END, ''), nullif(text, '')) <> ''"))(
    lambda s, sf: enrich.chat_requests(fx.table(s, sf, "conversations"), F.when(F.col("turn") % 2 == 0, F.lit("Summarise:")).otherwise(F.lit("")), "text",
                                       F.when(F.col("role") == "user", F.lit("Be brief."))).filter("messages is not null").select(
        "conv_id", "turn", F.concat(F.when(F.size("messages") == 2, F.concat_ws("|", F.col("messages")[0]["role"], F.col("messages")[0]["content"])).otherwise(F.lit("")), F.lit("#"),
                                    F.concat_ws("|", F.element_at("messages", -1)["role"], F.element_at("messages", -1)["content"])).alias("flat")))


def fake_model(request: str) -> str:
    """Stands for a model client: answers with the request length, refuses requests with steps 1."""
    if '"steps":1}' in request:
        raise ValueError("refused")
    return f"len {len(request)}"


query("E8_call_model", K.sql("SELECT request_id, key, CASE WHEN contains(request, '\"steps\":1}') THEN NULL ELSE 'len ' || length(request) END AS answer, "
                             "CASE WHEN contains(request, '\"steps\":1}') THEN 'ValueError: refused' END AS error FROM ms", _RAW, _SPLIT))(
    lambda s, sf: enrich.call_model(_split(s, sf)[1], fake_model))


def model_schemas(s, sf):
    """One interface document per part."""
    p = fx.table(s, sf, "part")
    body = F.concat(
        F.lit('{"latest_version":{"id":"v'), "p_partkey", F.lit('","openapi_schema":{"components":{"schemas":{"Mode":{"enum":["a",2],"type":"string"},"Input":{"required":["image","mode"],"properties":{'
              '"mode":{"allOf":[{"$ref":"#/components/schemas/Mode"}],"x-order":2},"image":{"type":"string","description":"'), "p_name",
        F.lit('","x-order":1},"steps":{"type":"integer","default":'), "p_size", F.lit(',"x-order":'), (F.col("p_partkey") % 3).cast("string"),
        F.lit('},"odd":{"$ref":"#/components/schemas/Nope"}}}}}}}}'))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 9 == 4, F.lit('{"latest_version":null}')).otherwise(body).alias("schema_json"))


_FLD = lambda name, typ, pos, req, dflt="NULL", desc="NULL", enum="NULL": (
    f"SELECT p_partkey, 'v' || p_partkey AS version, {pos}::DOUBLE AS pos, '{name}' AS name, '{typ}' AS type, {dflt}::VARCHAR AS \"default\", {desc}::VARCHAR AS description, {req} AS required, "
    f"{enum}::VARCHAR AS enum FROM part WHERE p_partkey%9<>4")
query("E9_schema_fields", " UNION ALL ".join([
    _FLD("mode", "string", "2", "true", enum="'\"a\",2'"), _FLD("image", "string", "1", "true", desc="p_name"),
    _FLD("steps", "integer", "p_partkey%3", "false", dflt="p_size"), _FLD("odd", "unknown", "0", "false")]))(
    lambda s, sf: enrich.schema_fields(model_schemas(s, sf), "schema_json", "p_partkey").select(
        "p_partkey", "version", "pos", "name", "type", "default", "description", "required", F.when(F.col("enum").isNotNull(), F.array_join("enum", ",")).alias("enum")))


# ---- T -------------------------------------------------------------------------------------
def scratch(s) -> str:
    ensure_checkpoint_dir(s)
    return f"{s.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def landed_pixels(s, sf) -> str:
    """the embedding images as files that arrive over time."""
    path = f"{scratch(s)}/in"
    fx.px_embed(s, sf).select(*PIXEL).repartition(8, "image_id").write.parquet(path)
    return path


@query("T1_stream_colour", K.rgb_map(lambda ch, i: f"255-{ch}"))
def _t1(s, sf):
    base = scratch(s)
    streams.stream_colour(streams.read_pixel_stream(s, landed_pixels(s, sf), 2), color.invert, f"{base}/out", f"{base}/cp").awaitTermination()
    return s.read.parquet(f"{base}/out").select(*OUT)


@query("T2_stream_histogram", K.sql("SELECT image_id, frame, channel, bin, n FROM hi", K.PX, HIST.format("px")))
def _t2(s, sf):
    base = scratch(s)
    streams.stream_histogram(streams.read_pixel_stream(s, landed_pixels(s, sf), 3), f"{base}/out", f"{base}/cp").awaitTermination()
    return streams.latest_counts(s, f"{base}/out")


@query("T2_closed_histograms", K.sql("SELECT image_id, frame, channel, bin, n FROM hi", K.PX, HIST.format("px")))
def _t2_closed(s, sf):
    base = scratch(s)
    streams.stream_closed_histograms(streams.read_pixel_stream(s, landed_pixels(s, sf), 3), f"{base}/out", f"{base}/cp").awaitTermination()
    return s.read.parquet(f"{base}/out").filter("complete").drop("complete")


def run_log(s, sf):
    """Every event is a run of its user's node, started at the version of its time."""
    e = fx.table(s, sf, "events")
    return e.select(F.col("user_id").alias("node_id"), F.expr("event_id div 64").alias("epoch"), F.col("event_id").alias("run_id"), "value")


def version_log(s, sf):
    """Every event names a version; one in five already names the next."""
    return fx.table(s, sf, "events").select(F.col("user_id").alias("node_id"), F.expr("(event_id + IF(event_id % 5 = 0, 64, 0)) div 64").alias("epoch"))


_T3 = ("SELECT r.node_id, r.epoch, r.run_id, r.value FROM (SELECT user_id AS node_id, event_id//64 AS epoch, event_id AS run_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k "
       "FROM events) r LEFT JOIN (SELECT user_id, max((event_id + CASE WHEN event_id%5=0 THEN 64 ELSE 0 END)//64) AS now FROM events GROUP BY user_id) v ON v.user_id=r.node_id "
       "WHERE k=1 AND r.epoch = coalesce(now, 0)")
query("T3_latest_run_wins", _T3)(lambda s, sf: streams.latest_run_wins(run_log(s, sf), version_log(s, sf)))


@query("T3_stream_latest_runs", _T3)
def _t3(s, sf):
    base = scratch(s)
    run_log(s, sf).repartition(4, "run_id").write.parquet(f"{base}/in")
    src = s.readStream.schema("node_id long, epoch long, run_id long, value double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    streams.stream_latest_runs(src, version_log(s, sf), f"{base}/out", f"{base}/cp").awaitTermination()
    return streams.settled_runs(s, f"{base}/out", version_log(s, sf))
