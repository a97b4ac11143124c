"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_groups
from .licenses import scan
from .mixing import domain_of, select_mix
from .near_dedup import near_groups
from .packing import pack
from .pii import find
from .quality import ledger, verdicts
from .sharding import shard
from .suffixes import repeated_passages
from .warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op2_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_minimax_sharding")
def op4_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8)


@query(
    "op10_warc_segments",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS leader FROM pages)
    SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
               (instr('0123456789abcdef', substr(h, (5 * i // 4 + 1)::INTEGER, 1)) - 1) * 16
               + greatest(0, instr('0123456789abcdef', substr(h || '0', (5 * i // 4 + 2)::INTEGER, 1)) - 1)
           ) >> (3 - 5 * i % 4)::INTEGER) % 32, 1)), '') AS payload_digest,
           CASE WHEN page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> leader THEN leader END AS refers_to, true AS intact
    FROM p
    """,
)
def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages"))


@query(
    "op3_quality_ledger",
    r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    p AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
    m AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g),
    r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM m, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid),
    f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                 len(l)::BIGINT AS n_lines FROM p LEFT JOIN r USING (rid)),
    b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                 + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
                 + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failures FROM f)
    SELECT *, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept FROM b
    """,
)
def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(ledger(table(spark, sf_dir, "documents")))


@query(
    "op1_minhash_near_dedup",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
    l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
    c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least AS component_id, d.doc_id = least AS kept FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
)
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=4, percent=80)


#: Weights among siblings; nodes that are not named weigh 1.
MIX_WEIGHTS = {("domain0",): 3.0, ("domain1",): 2.0, ("domain0", "en"): 2.0, ("domain1", "en", "src1"): 4.0}


def mix_sql(weights: dict[tuple, float], share: float, epochs: int, seed: int) -> str:
    """The mix in SQL. Siblings in order of supply a weight: the first of them are full, the others share what is left by
    weight, in whole tokens, and get what rounding leaves one each in order of name."""
    leaf, ctes = ["domain", "lang", "source"], []
    listed = ", ".join("(" + ", ".join([*(f"'{x}'" for x in (*path, *["*"] * (3 - len(path)))), str(float(w))]) + ")" for path, w in weights.items())
    for i in range(1, 4):
        keys, up = ", ".join(leaf[:i]), ", ".join(leaf[: i - 1]) or "1"
        of = f"OVER (PARTITION BY {up})"
        budget = f"(SELECT least(floor({share} * sum(t)), {epochs} * sum(t)) FROM leaf)" if i == 1 else "p.b"
        parent = "" if i == 1 else f" JOIN b{i - 1} p USING ({', '.join(leaf[: i - 1])})"
        match = " AND ".join(f"w.{c} = {f'c.{c}' if j < i else chr(39) + '*' + chr(39)}" for j, c in enumerate(leaf))
        backwards = ", ".join(f"{c} DESC" for c in leaf[:i])
        ctes += [
            f"c{i} AS (SELECT c.*, coalesce(w.weight, 1.0) AS w FROM (SELECT {keys}, {epochs} * sum(t) AS s FROM leaf GROUP BY {keys}) c LEFT JOIN weights w ON {match})",
            f"o{i} AS (SELECT c{i}.*, {budget} AS whole_b, sum(s) OVER (PARTITION BY {up} ORDER BY s / w, {keys} ROWS UNBOUNDED PRECEDING) - s AS before, sum(w) OVER (PARTITION BY {up} ORDER BY s / w DESC, {backwards} ROWS UNBOUNDED PRECEDING) AS rest_w FROM c{i}{parent})",
            f"f{i} AS (SELECT *, s * rest_w <= (whole_b - before) * w AS filled FROM o{i})",
            f"l{i} AS (SELECT *, whole_b - sum(CASE WHEN filled THEN s ELSE 0 END) {of} AS remains, sum(CASE WHEN filled THEN 0 ELSE w END) {of} AS open_w FROM f{i})",
            f"g{i} AS (SELECT *, CASE WHEN filled THEN s ELSE least(s, floor(remains * w / open_w)) END AS given FROM l{i})",
            f"h{i} AS (SELECT *, remains - sum(CASE WHEN filled THEN 0 ELSE given END) {of} AS rest, NOT filled AND given < s AS room FROM g{i})",
            f"b{i} AS (SELECT {keys}, (given + CASE WHEN room AND row_number() OVER (PARTITION BY {up}, room ORDER BY {keys}) <= rest THEN 1 ELSE 0 END)::BIGINT AS b FROM h{i})",
        ]
    return f"""WITH r AS (SELECT doc_id, CASE WHEN n = '' THEN 'other' ELSE 'domain' || (n::BIGINT % 3) END AS domain, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, n_tokens FROM (SELECT doc_id, lang, source,
 regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS n, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents)),
 leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS t FROM r GROUP BY ALL), weights(domain, lang, source, weight) AS (VALUES {listed}), {", ".join(ctes)},
 plan AS (SELECT domain, lang, source, CASE WHEN t > 0 THEN b // t ELSE 0 END AS whole, CASE WHEN t > 0 THEN b % t ELSE 0 END AS part FROM leaf JOIN b3 USING (domain, lang, source)),
 k AS (SELECT r.*, whole, part, md5(concat_ws(':', '{seed}', whole::VARCHAR, coalesce(doc_id::VARCHAR, 'null'))) AS h FROM r JOIN plan USING (domain, lang, source)),
 e AS (SELECT domain, lang, source, h, sum(sum(n_tokens)) OVER (PARTITION BY domain, lang, source ORDER BY h) - sum(n_tokens) AS before FROM k GROUP BY 1, 2, 3, 4)
 SELECT doc_id, k.domain, k.lang, k.source, n_tokens, (whole + CASE WHEN part > 0 AND before < part THEN 1 ELSE 0 END)::BIGINT AS copies FROM k JOIN e USING (domain, lang, source, h)"""


@query("op6_hierarchical_mix", mix_sql(MIX_WEIGHTS, 0.5, 2, 7))
def op6_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_mix(table(spark, sf_dir, "documents"), domain_of(), share=0.5, weights=MIX_WEIGHTS, epochs=2, seed=7)


@query("op9_license_signatures")
def op9_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")


@query("op5_bootstrapped_pii")
def op5_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


@query(
    "op7_sparse_suffix_passages",
    f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     h AS (SELECT doc_id, w, md5(array_to_string(w, ' ')) AS t FROM d),
     x AS (SELECT t, any_value(w) AS w, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS copies FROM h GROUP BY t),
     g AS (SELECT t, first_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS k FROM (SELECT t, first_id, w, unnest(range(len(w) - 49)) AS i FROM x WHERE len(w) >= 50)),
     k AS (SELECT k, min(struct_pack(id := first_id, t := t)) AS a, max(t) AS u, min(t) AS v FROM g GROUP BY k HAVING count(DISTINCT t) > 1),
     s AS (SELECT g.k, min(struct_pack(id := first_id, t := t)) AS b FROM g JOIN k ON k.k = g.k AND g.t <> k.a.t GROUP BY g.k),
     m AS (SELECT g.t, g.i, CASE WHEN g.t = k.a.t THEN s.b.id ELSE k.a.id END AS other FROM g JOIN k USING (k) JOIN s USING (k)),
     o AS (SELECT *, sum(opens) OVER (PARTITION BY t ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - coalesce(lag(i) OVER (PARTITION BY t ORDER BY i), -51) > 50 THEN 1 ELSE 0 END AS opens FROM m)),
     p AS (SELECT t, min(i) AS start_word, max(i) + 50 AS end_word, min(other) AS other_id FROM o GROUP BY t, run)
     SELECT doc_id, start_word, end_word, end_word - start_word AS n_words, other_id FROM h JOIN p USING (t) WHERE t NOT IN (SELECT t FROM x WHERE copies > 1)
     UNION ALL SELECT doc_id, 0, len(h.w)::BIGINT, len(h.w)::BIGINT, CASE WHEN doc_id = first_id THEN last_id ELSE first_id END FROM h JOIN x USING (t) WHERE copies > 1 AND len(h.w) >= 50
    """,
)
def op7_sparse_suffix_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
