"""One query per operator over the whole test tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, classes, decontamination, licenses, mixing, quality, repair, sharding, simhash, spelling, substrings, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op1_benchmark_decontamination",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, w[s:s + 9] AS terms, array_to_string(w[s:s + 9], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT k FROM win),
    g AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS gram
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
    m AS (SELECT g.doc_id, g.s, g.k, win.item_id FROM g JOIN win USING (k, gram)),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
    i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id),
    c AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
    rare AS (SELECT item_id, terms, arg_min(term, 100 * n + place) AS term
             FROM (SELECT item_id, terms, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS place FROM win) JOIN c USING (term)
             GROUP BY item_id, terms),
    around AS (SELECT doc_id, w[p] AS term, w[greatest(1, p - 19):p + 19] AS near
               FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) WHERE w[p] IN (SELECT term FROM rare)),
    x AS (SELECT doc_id, count(*) AS n_near, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM around JOIN rare USING (term) WHERE list_has_all(near, terms))
          GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
           sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated,
           coalesce(x.n_near, 0) AS n_near_items, sha256(coalesce(x.ids, '')) AS near_items_sha256
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN x USING (doc_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside a ten-word window of a benchmark item, and items whose words stand close together."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), within=decontamination.WITHIN)

    def digest(items: str):
        return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)

    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        digest("items").alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
        digest("near_items").alias("near_items_sha256"),
    )


TOKEN_LIMIT = 1024


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    found = tokens.token_counts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query("op7_license_scans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and restriction of every document."""
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        "score",
        F.concat_ws("; ", "expressions").alias("expressions"),
    )


TOXIC_FROM = 0.7


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        "log_ratio",
    )


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query(
    "op2_temperature_mixing",
    r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n, coalesce(md5(text), '') AS m FROM documents),
    t AS (SELECT source, CAST(sum(n) AS BIGINT) AS total FROM d GROUP BY source HAVING sum(n) > 0),
    x AS (SELECT max(total) AS top, min(total) AS least FROM t),
    a AS (SELECT top, CASE WHEN top <= 2 * least THEN 0.0 ELSE 1 - ln(2.0) / ln(top / least) END AS alpha FROM x),
    q AS (SELECT source, total, CAST(round(total * pow(top / total, 1 - alpha)) AS BIGINT) AS quota FROM t, a),
    u AS (SELECT d.doc_id, d.source, d.n, d.m, coalesce(quota // total, 1) AS passes, coalesce(quota % total, 0) AS rest,
                 unnest(range(0, coalesce(quota // total, 1) + CASE WHEN coalesce(quota % total, 0) > 0 THEN 1 ELSE 0 END)) AS block
          FROM d LEFT JOIN q ON d.source = q.source),
    h AS (SELECT *, CAST('0x' || substr(md5('42:' || block || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || m), 1, 15) AS BIGINT) AS number FROM u),
    r AS (SELECT *, row_number() OVER w - 1 AS place, sum(n) OVER w AS upto FROM h WINDOW w AS (PARTITION BY source, block ORDER BY number ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, source, n AS n_tokens, block, CAST(place AS BIGINT) AS place FROM r WHERE block < passes OR upto <= rest
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of every document in a mixture that repeats no source more than twice."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "block", "place")


@query("op4_interleaved_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, under the law of equal row counts."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        "source",
        sharding.number(docs).alias("number"),
    )
    found = sharding.assign(rows)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


TOOL_SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "lookup": {"key": ("string", True)},
    "count": {"text": ("string", True), "exact": ("boolean", False)},
}


@query(
    "op5_tool_call_linking",
    """
    WITH RECURSIVE c AS (SELECT conv_id, turn, text, length(text) AS n, 'call-' || turn AS call_id,
                      CASE length(text) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'count' END AS name,
                      CASE WHEN conv_id % 5 = 0 AND turn % 8 = 0 THEN 'call-' || (turn + 2) WHEN turn >= 2 AND turn % 6 <> 0 THEN 'call-' || (turn - 2) END AS dep
               FROM conversations WHERE role = 'user'),
    r AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn AS result_turn, text AS output FROM conversations WHERE role = 'assistant'),
    e AS (SELECT c.conv_id, c.call_id, c.turn, d.call_id AS dep, d.turn AS dep_turn FROM c JOIN c d ON c.conv_id = d.conv_id AND c.dep = d.call_id),
    ahead AS (SELECT DISTINCT conv_id FROM e WHERE dep_turn >= turn),
    walk AS (SELECT conv_id, call_id, 0 AS level FROM c WHERE conv_id IN (SELECT conv_id FROM ahead) AND (conv_id, call_id) NOT IN (SELECT (conv_id, call_id) FROM e)
             UNION ALL SELECT e.conv_id, e.call_id, walk.level + 1 FROM walk JOIN e ON e.conv_id = walk.conv_id AND e.dep = walk.call_id),
    l AS (SELECT c.*, CASE WHEN c.conv_id IN (SELECT conv_id FROM ahead) THEN w.level ELSE 0 END AS level, r.result_turn, r.output,
                 c.dep IS NOT NULL AND (c.conv_id, c.dep) NOT IN (SELECT (conv_id, call_id) FROM c) AS unknown
          FROM c LEFT JOIN walk w ON c.conv_id = w.conv_id AND c.call_id = w.call_id LEFT JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
    a AS (SELECT *, CASE name
              WHEN 'search' THEN '{"limit":' || CASE WHEN turn % 10 = 4 THEN '"many"' ELSE CAST(n AS VARCHAR) END || ',"query":' || CAST(to_json(text) AS VARCHAR) || '}'
              WHEN 'lookup' THEN CASE WHEN n % 7 = 0 THEN '{"name":' || CAST(to_json(substr(text, 1, 20)) AS VARCHAR) || '}' ELSE '{"key":' || CAST(to_json(substr(text, 1, 20)) AS VARCHAR) || '}' END
              ELSE '{"exact":true,"text":' || CAST(to_json(text) AS VARCHAR) || '}' END AS args FROM l),
    s AS (SELECT *, [
              CASE WHEN level IS NULL THEN 'cycle' END,
              CASE WHEN name = 'search' AND turn % 10 = 4 THEN 'limit is no integer' END,
              CASE WHEN name = 'lookup' AND n % 7 = 0 THEN 'missing key' END,
              CASE WHEN result_turn IS NULL THEN 'no result' END,
              CASE WHEN name = 'lookup' AND n % 7 = 0 THEN 'unexpected name' END,
              CASE WHEN unknown THEN 'unknown dependency' END] AS errors FROM a)
    SELECT conv_id, call_id, turn, CASE WHEN level IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, level IS NULL ORDER BY level, turn, call_id) - 1 END AS position,
           level, result_turn, coalesce(array_to_string(errors, '; '), '') AS errors,
           '{"arguments":' || args || ',"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(CAST(to_json(output) AS VARCHAR), 'null') || '}' AS json
    FROM s
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call of a tool, every assistant turn as the result of the call before it.

    The arguments are written with their keys in another order and with spaces; some miss a field, have one
    too many or of a wrong type, and some calls depend on later ones or on each other.
    """
    turns = table(spark, sf_dir, "conversations")
    n, turn = F.length("text"), F.col("turn")
    quoted = F.expr("substr({0}, 6, length({0}) - 6)".format("to_json(struct(text as v))"))
    short = F.expr("substr({0}, 6, length({0}) - 6)".format("to_json(struct(substr(text, 1, 20) as v))"))
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("count")
    arguments = (
        F.when(n % 3 == 0, F.concat(F.lit('{"query": '), quoted, F.lit(', "limit": '), F.when(turn % 10 == 4, '"many"').otherwise(n.cast("string")), F.lit("}")))
        .when(n % 3 == 1, F.concat(F.when(n % 7 == 0, '{ "name" : ').otherwise('{ "key" : '), short, F.lit(" }")))
        .otherwise(F.concat(F.lit('{"text": '), quoted, F.lit(', "exact": true}')))
    )
    dep = F.when((F.col("conv_id") % 5 == 0) & (turn % 8 == 0), F.concat(F.lit("call-"), turn + 2)).when((turn >= 2) & (turn % 6 != 0), F.concat(F.lit("call-"), turn - 2))
    calls = turns.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("call-"), turn).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.array_compact(F.array(dep)).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("call-"), turn - 1).alias("call_id"), F.col("text").alias("output"))
    found = chat.link_calls(calls, results, TOOL_SCHEMAS)
    return found.select("conv_id", "call_id", "turn", "position", "level", "result_turn", F.concat_ws("; ", "errors").alias("errors"), "json")


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are left without passages of 35 words found elsewhere."""
    found = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op13_spelling_variants",
    r"""
    WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS t FROM range(256) AS r(i)),
    r AS (SELECT doc_id, run, count(*) AS k
          FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
          WHERE length(run) >= 7 GROUP BY ALL),
    x AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hex FROM r),
    h AS (SELECT run, k, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(hex) // 2), lambda i: CAST('0x' || substr(hex, 2 * i + 1, 2) AS BIGINT))),
                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM x, tab),
    d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
    w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
    p AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
    near AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM p a JOIN p b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
             UNION SELECT a.word, b.word, b.n FROM p a JOIN w b ON a.less = b.word
             UNION SELECT b.word, a.word, a.n FROM p a JOIN w b ON a.less = b.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
    ends AS (SELECT walk.word, walk.root FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words one edit apart, and the frequent word that each is a variant of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query(
    "op11_structure_repair",
    r"""
    WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS t FROM range(256) AS r(i)),
    c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k FROM conversations),
    h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(k, lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM c, tab),
    x AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
    r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM x),
    f AS (SELECT *, substr(role, 1, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
                 CASE WHEN i > 1 AND lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM r),
    n AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
                 count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, CAST(sum(illegal) AS BIGINT) AS illegal FROM f GROUP BY conv_id),
    back AS (SELECT conv_id, rows + 1 AS i, 0 AS f0, 6 AS f1, 3 AS f2, 0 AS f3 FROM n
             UNION ALL
             SELECT conv_id, i, least(g0, 3 + g2, 6 + g3), least(g1, 3 + g2, 6 + g3), least(g2, 3 + g3), least(g3, 3 + g2)
             FROM (SELECT f.conv_id, f.i,
                          CASE WHEN fault IN ('b', 'd') THEN 4 + f0 ELSE least(4 + f0, t + 3 + f2, CASE c WHEN 's' THEN t + f1 WHEN 'u' THEN t + f2 ELSE 1000000 END) END AS g0,
                          CASE WHEN fault IN ('b', 'd') THEN 4 + f1 ELSE least(4 + f1, t + 3 + f2, CASE c WHEN 'u' THEN t + f2 ELSE 1000000 END) END AS g1,
                          CASE WHEN fault IN ('b', 'd') THEN 4 + f2 ELSE least(4 + f2, t + 3 + f3, CASE c WHEN 'a' THEN t + f3 ELSE 1000000 END) END AS g2,
                          CASE WHEN fault IN ('b', 'd') THEN 4 + f3 ELSE least(4 + f3, t + 3 + f2, CASE c WHEN 'u' THEN t + f2 ELSE 1000000 END) END AS g3
                   FROM (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS t FROM f) f JOIN back ON back.conv_id = f.conv_id AND back.i = f.i + 1)),
    v AS (SELECT conv_id, i, [f0, f1, f2, f3] AS f FROM back),
    walk AS (SELECT conv_id, 1::BIGINT AS i, 0 AS s, '' AS audit, NULL::VARCHAR AS text, false AS done FROM n
             UNION ALL
             SELECT conv_id, CASE WHEN letter IN ('I', '') THEN i ELSE i + 1 END, CASE letter WHEN 'K' THEN k WHEN 'D' THEN s WHEN '' THEN s ELSE due END, audit || letter,
                    CASE WHEN letter IN ('D', '') THEN text ELSE concat_ws(chr(10), text, CASE WHEN letter = 'K' THEN role ELSE CASE due WHEN 2 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE line END) END,
                    letter = ''
             FROM (SELECT *, CASE WHEN role IS NULL AND now = 0 THEN '' WHEN role IS NOT NULL AND 4 + after[s + 1] = now THEN 'D' WHEN 3 + here[due + 1] = now THEN 'I'
                                  WHEN k IS NOT NULL AND t + after[k + 1] = now THEN 'K' ELSE 'R' END AS letter
                   FROM (SELECT walk.conv_id, walk.i, walk.s, walk.audit, walk.text, a.f AS here, a.f[walk.s + 1] AS now, b.f AS after, f.role, f.text AS line, CASE WHEN walk.s = 2 THEN 3 ELSE 2 END AS due,
                                CASE WHEN fault = 't' THEN 3 ELSE 0 END AS t,
                                CASE WHEN c = 's' AND s = 0 THEN 1 WHEN c = 'u' AND s <> 2 THEN 2 WHEN c = 'a' AND s = 2 THEN 3 END AS k
                         FROM walk JOIN v a ON a.conv_id = walk.conv_id AND a.i = walk.i LEFT JOIN v b ON b.conv_id = walk.conv_id AND b.i = walk.i + 1
                         LEFT JOIN f ON f.conv_id = walk.conv_id AND f.i = walk.i WHERE NOT walk.done))),
    o AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(v.f[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(walk.text, '')) AS repaired_sha256
    FROM o LEFT JOIN n USING (conv_id) LEFT JOIN v ON v.conv_id = o.conv_id AND v.i = 1 LEFT JOIN walk ON walk.conv_id = o.conv_id AND walk.done
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after the damage, and its cheapest repair."""
    turns = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(turns), turns)


@query("op12_class_lm_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a class-based bigram model learned from four fifths of them."""
    return classes.class_scores(table(spark, sf_dir, "documents"))
