"""The corpus operators' registered queries and their SQL.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, fill_in_middle, host_reputation, line_dedup, order_minhash, packing, ppm_language, quality, sharding, spelling, suffix_dedup, token_store
from .common import discard, ship_package, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    report = line_dedup.line_report(documents, line_dedup.duplicate_lines(documents))
    return report.withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


def op2_line_dedup_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The former name of op2_line_dedup over all lines; both are one."""
    return op2_line_dedup(spark, sf_dir)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pat = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pat).drop("text")
    digest = encoded.withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = bpe.decode(digest, ranks, pat)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def packed_pieces(documents: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(documents, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    light = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    light = staged(light, "pieces")
    packed = packing.pack(light, capacity=1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    discard(light)
    return packed


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v1")
    base = F.col("failure_bits").bitwiseAND(F.lit(quality.mask_of("base"))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failure_bits")


def op4_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93).select("vec_id", "n_links", "component_id", "kept")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "component_id", "kept")


def op6_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 40)


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = ppm_language.held_out(F.col("doc_id"))
    model = ppm_language.fit(documents.where(~held_out))
    return ppm_language.predict(documents.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: Fixed rules of the registered query: verdict and pattern.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the quality labels, taken as labels of the pages with the same number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = host_reputation.judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does to each policy, from a ledger that is stored once and read under both policies."""
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "failure_bits")
    stored = staged(rows, "quality-ledger")
    found = [quality.ablations(stored, p).select(F.lit(p).alias("policy"), "*") for p in quality.POLICIES]
    return found[0].unionByName(found[1])


QUERIES = {f.__name__: f for f in (op1_quality_rules, quality_ablations, op2_line_dedup, op2_line_dedup_all_lines, op3_byte_bpe, op4_itq_embeddings, op5_order_minhash, op6_label_propagation, op7_ppm_language, op8_bit_packed_ids, op9_host_reputation, op10_best_fit_packing, op11_suffix_dedup, op12_fill_in_middle, op13_spelling_variants)}

_SPLIT = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_ONLY = lambda kept: f"length(regexp_replace(coalesce(text, ''), '[^{kept}]', '', 'g'))"

OP1_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_SPLIT} AS words FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i+1], words[i+2]) AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, {_ONLY("#*$%&|<>")} AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, {_ONLY("A-Z")} AS n_upper, {_ONLY("a-z")} AS n_lower FROM w LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {c} THEN {quality.bit_of(r)} ELSE 0 END" for r, c in quality.RULES.items())})::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & {quality.mask_of("base")} <> 0 AS base_failed, failure_bits & {quality.mask_of("v1")} = 0 AS kept, failure_bits FROM b"""

#: Lines of any number of words are compared; those in g may have neighbours.
OP2_SQL = f"""
WITH t AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
li AS (SELECT doc_id, line_no, list_filter(string_split(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' '), lambda x: x <> '') AS words FROM t),
o AS (SELECT DISTINCT doc_id, line_no, words, array_to_string(words, ' ') AS norm FROM li WHERE len(words) > 0),
f AS (SELECT norm, any_value(words) AS words, min({{'d': doc_id, 'l': line_no}}) AS first FROM o GROUP BY norm),
g AS (SELECT * FROM f WHERE len(words) >= {line_dedup.MIN_WORDS}),
v AS (SELECT norm, first, len(words) AS n, i, array_to_string(list_concat(words[:i-1], words[i+1:]), ' ') AS rest FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM g)),
c AS (SELECT norm, first, min(first) OVER (PARTITION BY n, i, rest) AS other FROM v UNION ALL SELECT v.norm, v.first, g.first FROM v JOIN g ON v.rest = g.norm UNION ALL SELECT g.norm, g.first, v.first FROM v JOIN g ON v.rest = g.norm),
near AS (SELECT norm FROM c GROUP BY norm, first HAVING min(other) < first),
d AS (SELECT doc_id, line_no, {{'d': doc_id, 'l': line_no}} = first AS is_near FROM o JOIN f USING (norm) WHERE {{'d': doc_id, 'l': line_no}} <> first OR norm IN (SELECT norm FROM near)),
r AS (SELECT doc_id, count(*) FILTER (NOT is_near) AS n_equal, count(*) FILTER (is_near) AS n_near, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS dropped FROM d GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(n_equal, 0) AS n_equal, coalesce(n_near, 0) AS n_near, coalesce(dropped, '') AS dropped FROM documents LEFT JOIN r USING (doc_id)"""

OP4_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""


def _op9_sql() -> str:
    def level(name: str, source: str) -> str:
        return f"""{name} AS (SELECT CASE WHEN p * (1 - p) > 0 AND room > 0 THEN (bb - bad * p - p * (1 - p) * (k - 1)) / (p * (1 - p) * room) END AS rho FROM
  (SELECT *, n - nn / n - (k - 1) AS room, bad / n AS p FROM (SELECT sum(n) AS n, sum(bad) AS bad, count(*) AS k, sum(n * n) AS nn, sum(bad * bad / n) AS bb FROM {source} WHERE n > 0)))"""

    strength = lambda name: f"(SELECT 1 / greatest(0.001, least(0.5, coalesce(rho, 0.001))) - 1 FROM {name})"
    ranked = sorted(URL_RULES, key=lambda r: (-len(r[1]), -r[1].index("/")))
    fits = [(f"(host = '{p.split('/')[0]}' OR ends_with(host, '.{p.split('/')[0]}')) AND starts_with(path, '/{p.partition('/')[2]}')", v, p) for v, p in ranked]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    doubles = ", ".join(f"'{x}'" for x in host_reputation.DOUBLE_SUFFIXES)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
bare AS (SELECT DISTINCT host, string_split(b, '.') AS l, b, regexp_matches(b, '^[0-9]+([.][0-9]+){{3}}$|^\\[') AS ip, array_to_string(string_split(b, '.')[-2:], '.') IN ({doubles}) AS wide
  FROM (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS b FROM h)),
place AS (SELECT host, CASE WHEN ip THEN b WHEN wide THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain, CASE WHEN ip THEN b WHEN wide THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM bare),
hosts AS (SELECT host, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM h JOIN place USING (host) LEFT JOIN k USING (page_id) GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
top AS (SELECT coalesce(sum(n), 0) AS n, (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS rate FROM suffixes),
{level("mh", "hosts")}, {level("md", "domains")}, {level("ms", "suffixes")},
s AS (SELECT suffix, s.n, (bad + least({strength("ms")}, t.n + 1) * rate) / (s.n + least({strength("ms")}, t.n + 1)) AS rate FROM suffixes s CROSS JOIN top t),
d AS (SELECT domain, d.suffix, d.n, (bad + least({strength("md")}, s.n + 1) * rate) / (d.n + least({strength("md")}, s.n + 1)) AS rate FROM domains d JOIN s ON d.suffix = s.suffix),
r AS (SELECT host, (bad + w * prior) / (n + w) AS rate, n + w AS size FROM (SELECT host, x.n, x.bad, d.rate AS prior, least({strength("mh")}, d.n + 1) AS w FROM hosts x JOIN d ON x.domain = d.domain AND x.suffix = d.suffix))
SELECT page_id, host, path, {case(2)} AS rule, coalesce({case(1)}, CASE WHEN rate - {host_reputation.Z} * sqrt(rate * (1 - rate) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM h JOIN r USING (host)"""


#: Windows of 200 bytes by their digests; those found twice, joined to spans; what lies between the spans.
OP11_SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, b[i:i+199] AS s FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM t WHERE octet_length(b) >= 200)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM (SELECT r, i, md5(s) AS s FROM w)) WHERE n > 1),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, (i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) > 200)::INT AS new FROM c)),
s AS (SELECT r, k, min(i) AS a, max(i) + 200 AS e FROM g GROUP BY r, k),
p AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 1) AS last FROM s),
j AS (SELECT r, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(hex(b[last:a-1]), '' ORDER BY a) || hex(any_value(b)[max(e):octet_length(any_value(b))]) AS kept FROM p JOIN t USING (r) GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256 FROM t LEFT JOIN j USING (r)"""

_MARKED = " OR ".join(f"contains(t, '{m}')" for m in (fill_in_middle.PREFIX, fill_in_middle.SUFFIX, fill_in_middle.MIDDLE))
_FORMED = "CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END"
_CHANCE = ", ".join(f"('0x' || substr(d, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
OP12_SQL = f"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(w) AS n, {_CHANCE} FROM x),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR {_MARKED} OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, coalesce(array_to_string(w[:a], ''), '') AS p, coalesce(array_to_string(w[a + 1 : b], ''), '') AS m, coalesce(array_to_string(w[b + 1 :], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256({_FORMED}) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""


def _ablations_sql() -> str:
    bits = [(p, r, quality.mask_of(p), quality.bit_of(r)) for p, rules in quality.POLICIES.items() for r in rules]
    return f"""WITH f AS ({OP1_SQL}), r(policy, rule, mask, bit) AS (VALUES {", ".join(map(str, bits))})
SELECT policy, rule, count(*) FILTER (failure_bits & bit <> 0) AS failed, count(*) FILTER (failure_bits & mask = bit) AS rejected_alone, count(*) FILTER (failure_bits & mask & ~bit <> 0) AS rejected_without FROM f CROSS JOIN r GROUP BY policy, rule"""


ORACLE_SQL: dict[str, str] = {"quality_ablations": _ablations_sql(), "op1_quality_rules": OP1_SQL, "op2_line_dedup": OP2_SQL, "op2_line_dedup_all_lines": OP2_SQL, "op4_itq_embeddings": OP4_SQL, "op9_host_reputation": _op9_sql(), "op11_suffix_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL}


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


def queries() -> dict:
    return {name: _shipped(query) for name, query in QUERIES.items()}
