"""The registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.collocations import collocations
from scriptorium.llm.exact_dedup import exact_dedup
from scriptorium.llm.jaccard_join import near_duplicates
from scriptorium.llm.language_id import held_out, identify
from scriptorium.llm.lm_score import score_documents
from scriptorium.llm.mixing import mix
from scriptorium.llm.neighbours import nearest
from scriptorium.llm.packing import pack
from scriptorium.llm.quality_rules import judge_quality
from scriptorium.llm.substring_dedup import remove_repeats
from scriptorium.llm.url_filter import RULES, judge_urls
from scriptorium.llm.vector_codes import compress
from scriptorium.llm.warc import round_trip
from scriptorium.session import load, ship

#: Texts reach Python in batches of so many rows at most: memory stays bounded with texts of 100 kB and more.
BATCH_ROWS = 512


#: Identifiers that may be broadcast.
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pieces = pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    records = round_trip(load(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents labelled as good; a document counts as such if any of its labels says so."""
    prepare(spark)
    good = load(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("good_id")).distinct()
    docs = load(spark, sf_dir, "documents")
    # Texts are only shuffled where the labels are too many to broadcast.
    good = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    # Only what is scored is joined, under names of its own: documents may have a column of any name.
    marked = docs.select(docs["doc_id"], docs["text"]).join(good, docs["doc_id"] == good["good_id"], "left")
    return score_documents(marked, F.col("good_id").isNotNull())


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    judged = judge_urls(load(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: The driver tables hold no canonical links or refreshes; the tests hold aliases against a plain search of the graph.
OP4_SQL = """
WITH rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                                    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
cut AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
judged AS (SELECT page_id, host, path,
    (SELECT arg_max({'rule': h || p, 'action': action}, length(h || p)) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM cut)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM judged
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    kept = remove_repeats(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 49)) AS s, ws FROM w WHERE len(ws) >= 50),
grams AS (SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS gram FROM starts),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY gram) AS m FROM grams) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS i FROM dup),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.i) AS text, count(*) AS n FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i WHERE g.i IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    found = identify(docs, docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return nearest(load(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))
       WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY ALL
"""


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    judged = judge_quality(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Regular expressions of the character classes, in the operator's order; what is in none is the last.
_CLASSES = [
    r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?]", r"""['"()-]""", r"[#*$%&|<>]",
    r"[\x{80}-\x{2FF}]", r"[\x{300}-\x{7FF}]", r"[\x{800}-\x{FFFF}]", r"[\x{10000}-\x{10FFFF}]",
]


def _op11_sql() -> str:
    counts = [f"length(text) - length(regexp_replace(text, '{c.replace(chr(39), chr(39) * 2)}', '', 'g'))" for c in _CLASSES]
    counts.append(f"length(text) - {' - '.join(f'({c})' for c in counts)}")
    listed = ", ".join(f"({c})::BIGINT" for c in counts)
    part = "p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"
    return rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 2)) AS s, ws FROM w WHERE len(ws) >= 3),
grams AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, ws[s], ws[s + 1], ws[s + 2]) AS n FROM starts),
covered AS (SELECT doc_id, count(DISTINCT s + i) AS n FROM grams, (SELECT unnest([0, 1, 2]) AS i) WHERE n > 1 GROUP BY doc_id),
rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM rows WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, text, ws, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, [{listed}] AS classes,
    len(ws) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(ws) AS base_failed
    FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id LEFT JOIN dups ON w.doc_id = dups.doc_id),
held AS (SELECT lang, text, any_value(ws) AS ws, any_value(classes) AS classes, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS all_rows FROM base WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang, text),
times AS (SELECT lang, ws, classes, CASE WHEN n > 1 AND n * 1000 > all_rows THEN 1 ELSE n END AS n FROM held),
counted AS (SELECT lang, word, sum(n)::BIGINT AS n FROM (SELECT lang, n, unnest(list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS word FROM times) GROUP BY lang, word),
totals AS (SELECT lang, sum(n) AS total FROM counted GROUP BY lang HAVING sum(n) >= 5000),
common AS (SELECT c.lang, word, n::DOUBLE / total AS q FROM counted c JOIN totals t ON c.lang = t.lang WHERE n * 500 >= total),
bins AS (SELECT lang, word, q FROM common UNION ALL SELECT t.lang, NULL, greatest(0, 1 - coalesce(sum(q), 0)) FROM totals t LEFT JOIN common c ON t.lang = c.lang GROUP BY t.lang),
kinds AS (SELECT lang, i, sum(x * n)::DOUBLE AS x FROM (SELECT lang, n, unnest(classes) AS x, generate_subscripts(classes, 1) AS i FROM times) GROUP BY lang, i),
shares AS (SELECT lang, i, x / sum(x) OVER (PARTITION BY lang) AS q FROM kinds WHERE lang IN (SELECT lang FROM totals)),
own AS (SELECT doc_id, lang, x::DOUBLE / length(text) AS p, i FROM (SELECT doc_id, lang, text, unnest(classes) AS x, generate_subscripts(classes, 1) AS i FROM base WHERE length(text) >= 300)),
class_far AS (SELECT doc_id, sqrt(greatest(0, 0.5 * (sum({part}) + 1 - sum(q)))) AS d FROM own o JOIN shares s ON o.lang = s.lang AND o.i = s.i WHERE p > 0 GROUP BY doc_id),
placed AS (SELECT doc_id, t.lang, n_words, c.word FROM (SELECT doc_id, lang, n_words, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM base WHERE n_words >= 50) t
    JOIN totals ON t.lang = totals.lang LEFT JOIN common c ON t.lang = c.lang AND t.word = c.word),
mine AS (SELECT doc_id, lang, word, count(*)::DOUBLE / any_value(n_words) AS p FROM placed GROUP BY doc_id, lang, word),
word_far AS (SELECT doc_id, sqrt(greatest(0, 0.5 * (sum({part}) + 1 - sum(q)))) AS d FROM mine m JOIN bins b ON m.lang = b.lang AND m.word IS NOT DISTINCT FROM b.word GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(c.d <= 0.32, true) AND coalesce(v.d <= 0.2 + 2.0 / sqrt(n_words), true) AS kept
FROM base b LEFT JOIN class_far c ON b.doc_id = c.doc_id LEFT JOIN word_far v ON b.doc_id = v.doc_id
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return collocations(load(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS k),
starts AS (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS s FROM w, sizes WHERE len(ws) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS n FROM (SELECT lang, k, array_to_string(ws[s:s + k - 1], ' ') AS phrase FROM starts) GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k AS size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k >= 2),
cuts AS (SELECT lang, phrase, size, a, ws, unnest(generate_series(1, size - 1)) AS k FROM cand),
scored AS (SELECT c.lang, c.phrase, a, c.k, l.n AS l, r.n AS r, (2000000::HUGEINT * a) // (l.n + r.n) AS score FROM cuts c
    JOIN counts l ON c.lang = l.lang AND l.phrase = array_to_string(ws[1:c.k], ' ') JOIN counts r ON c.lang = r.lang AND r.phrase = array_to_string(ws[c.k + 1:size], ' ')),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM scored) WHERE i = 1),
subs AS (SELECT c.lang, c.size, ws, a, m.k AS m, unnest(generate_series(1, c.size - m.k + 1)) AS s FROM cand c, sizes m WHERE m.k >= 2 AND m.k < c.size),
longer AS (SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, max(a) AS most FROM subs GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN longer g ON w.lang = g.lang AND w.phrase = g.phrase WHERE g.most IS NULL OR 100 * g.most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT d.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked d JOIN totals t ON d.lang = t.lang WHERE rank <= 2000
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return compress(load(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    s = """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT vec_id, label, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) AS x FROM kept, (SELECT unnest([0, 1, 2, 3]) AS p)),
long AS (SELECT vec_id, p, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM cut),
book0 AS (SELECT p, e, i, x AS c FROM long JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < 256)"""
    for r in range(5):
        s += f""",
near{r} AS (SELECT vec_id, p, min(d * 256 + e) AS best FROM (SELECT l.vec_id, l.p, b.e, sum((l.x - b.c) * (l.x - b.c))::BIGINT AS d FROM long l JOIN book{r} b ON l.p = b.p AND l.i = b.i GROUP BY ALL) GROUP BY ALL)"""
        if r < 4:
            s += f""",
mean{r} AS (SELECT p, e, i, s, n FROM (SELECT l.p, n.best % 256 AS e, l.i, sum(l.x)::BIGINT AS s, count(*) AS n FROM long l JOIN near{r} n ON l.vec_id = n.vec_id AND l.p = n.p GROUP BY ALL)),
book{r + 1} AS (SELECT b.p, b.e, b.i, CASE WHEN m.n IS NULL THEN b.c ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS c FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e AND b.i = m.i)"""
    return s + """,
coded AS (SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(best % 256)), 2, '0'), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM kept k JOIN near4 n ON k.vec_id = n.vec_id GROUP BY k.vec_id, k.label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM book4) AS codebooks_sha256 FROM coded
"""


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_warc": op2_warc,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_url_filter": op4_url_filter,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_language_id": op6_language_id,
        "op7_mixing": op7_mixing,
        "op8_neighbours": op8_neighbours,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_quality_rules": op11_quality_rules,
        "op12_collocations": op12_collocations,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": OP2_SQL,
        "op4_url_filter": OP4_SQL,
        "op5_substring_dedup": OP5_SQL,
        "op9_exact_dedup": OP9_SQL,
        "op10_jaccard_join": OP10_SQL,
        "op11_quality_rules": _op11_sql(),
        "op12_collocations": OP12_SQL,
        "op13_vector_codes": _op13_sql(),
    }
