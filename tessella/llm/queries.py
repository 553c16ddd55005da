"""The operators applied to the standard tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.contamination import contamination_report, find_contamination
from tessella.llm.html import extract_text
from tessella.llm.langid import language_report
from tessella.llm.lines import line_report
from tessella.llm.merkle import audit_documents, proof_digest
from tessella.llm.mixing import BAD, GOOD, UNKNOWN, mix_plan
from tessella.llm.paragraphs import passage_report
from tessella.llm.simhash import near_duplicates
from tessella.llm.supermin import shingle_duplicates
from tessella.llm.tokens import token_shards
from tessella.llm.topk import top_k
from tessella.llm.trie import prefix_trie
from tessella.llm.urls import judge_urls

#: Path rules of the URL filter.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), k=5)
    return out.select("query_id", "rank", "vec_id", "score")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=3)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return contamination_report(found)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = audit_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=2, similarity=0.8)


QUERIES = {
    "op1_topk": op1_topk,
    "op2_token_shards": op2_token_shards,
    "op3_mixing": op3_mixing,
    "op4_passages": op4_passages,
    "op5_simhash": op5_simhash,
    "op6_html_text": op6_html_text,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_language": op9_language,
    "op10_url_filter": op10_url_filter,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle": op12_merkle,
    "op13_superminhash": op13_superminhash,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), one) - 1 AS i, one, chars
            FROM (SELECT conv_id, turn, role, length(coalesce(text, '')) AS chars, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS one FROM conversations WHERE conv_id IS NOT NULL)),
        convs AS (
            SELECT conv_id, n, conv_id - conv_id % 100 AS head, xor(4294967295::BIGINT,
                list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
                    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384::BIGINT) END)) % 6 AS h
            FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id)),
        rebuilt AS (
            SELECT c.conv_id, i + 1 AS depth, one, chars FROM convs AS c JOIN turns AS t ON t.conv_id = c.head AND i < h
            UNION ALL
            SELECT c.conv_id, least(h, coalesce(b.n, 0)) + i - h + 1, one, chars FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND i >= h LEFT JOIN (SELECT conv_id, n FROM convs) AS b ON b.conv_id = c.head),
        keyed AS (
            SELECT conv_id, depth, array_to_string(list(one) OVER (PARTITION BY conv_id ORDER BY depth), '') AS prefix, chars FROM rebuilt
            UNION ALL
            SELECT conv_id, 0, '', 0 FROM convs),
        nodes AS (SELECT min(conv_id) AS owner, depth, prefix, count(*) AS n_convs, any_value(chars) AS chars FROM keyed GROUP BY depth, prefix),
        members AS (SELECT k.conv_id, depth, owner FROM keyed AS k JOIN nodes AS n USING (depth, prefix)),
        parents AS (SELECT n.owner, n.depth, m.owner AS parent FROM nodes AS n LEFT JOIN members AS m ON m.conv_id = n.owner AND m.depth = n.depth - 1),
        children AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY parent, depth),
        judged AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes AS n LEFT JOIN children USING (owner, depth)),
        sums AS (
            SELECT m.owner, m.depth, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars)::BIGINT AS saved_tokens
            FROM judged AS u JOIN members AS m ON m.conv_id = u.owner AND m.depth <= u.depth GROUP BY m.owner, m.depth),
        ends AS (
            SELECT owner, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
            FROM members JOIN (SELECT conv_id, max(depth) AS depth FROM keyed GROUP BY conv_id) USING (conv_id, depth) GROUP BY owner, depth)
        SELECT j.owner AS conv_id, j.depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
        FROM judged AS j JOIN parents USING (owner, depth) JOIN sums USING (owner, depth) LEFT JOIN ends USING (owner, depth)""",
    "op12_merkle": """
        WITH RECURSIVE fields AS (
            SELECT doc_id, lang, source, n_chars, text,
                list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
                    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384::BIGINT) END) AS crc
            FROM documents),
        canonical AS (
            SELECT doc_id, lang, xor(crc, 4294967295::BIGINT) % 7 = 0 AS tampered, n_chars,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
                coalesce(strlen(text) || ':' || text, '-') AS after
            FROM fields),
        leaves AS (
            SELECT doc_id, coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
                sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || after) AS leaf,
                CASE WHEN tampered THEN sha256(before || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || after) END AS bent
            FROM canonical),
        nodes AS (
            SELECT tree, 0 AS level, i, n, leaf AS digest FROM leaves
            UNION ALL
            SELECT tree, any_value(level) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, i // 2),
        subroots AS (SELECT tree, digest AS subroot, level AS levels, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS level, i, n, subroot AS digest FROM subroots
            UNION ALL
            SELECT any_value(level) + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY i // 2),
        paths AS (
            SELECT l.doc_id, s.level, l.i >> s.level AS place, o.digest AS sibling
            FROM leaves AS l JOIN nodes AS s ON s.tree = l.tree AND s.n > 1 AND s.i = l.i >> s.level
            LEFT JOIN nodes AS o ON o.tree = s.tree AND o.level = s.level AND o.i = xor(s.i, 1)
            UNION ALL
            SELECT l.doc_id, r.levels + s.level, r.i >> s.level, o.digest
            FROM leaves AS l JOIN subroots AS r ON r.tree = l.tree JOIN tops AS s ON s.n > 1 AND s.i = r.i >> s.level
            LEFT JOIN tops AS o ON o.level = s.level AND o.i = xor(s.i, 1)),
        ways AS (SELECT doc_id, list(struct_pack(place, sibling) ORDER BY level) AS way, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256 FROM paths GROUP BY doc_id),
        climbs AS (
            SELECT l.doc_id, coalesce(l.bent, l.leaf) AS digest, 1 AS step, way FROM leaves AS l LEFT JOIN ways AS w ON w.doc_id = l.doc_id
            UNION ALL
            SELECT doc_id, sha256(CASE WHEN way[step].place % 2 = 1 THEN way[step].sibling || digest ELSE digest || coalesce(way[step].sibling, '') END), step + 1, way
            FROM climbs WHERE step <= coalesce(len(way), 0)),
        ends AS (SELECT doc_id, arg_max(digest, step) AS folded_root FROM climbs GROUP BY doc_id)
        SELECT l.doc_id, l.leaf, r.subroot, t.digest AS root, coalesce(w.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
        FROM leaves AS l JOIN subroots AS r ON r.tree = l.tree JOIN tops AS t ON t.n = 1 LEFT JOIN ways AS w ON w.doc_id = l.doc_id JOIN ends AS e ON e.doc_id = l.doc_id""",
    "op13_superminhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM sets AS a JOIN sets AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT a, b FROM pairs JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (
            SELECT doc_id AS node, doc_id AS other FROM w
            UNION SELECT node, b FROM reach JOIN both_ways ON other = a)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
        FROM w LEFT JOIN sizes USING (doc_id) JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) ON node = w.doc_id""",
    "op7_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        starts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM starts),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d JOIN sizes ON len(w) >= n),
        found AS (SELECT doc_id, i, p.n, item_id FROM places AS p JOIN windows ON windows.n = p.n AND windows.gram = array_to_string(w[i:i + p.n - 1], ' ')),
        hit AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS at_word FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        judged AS (SELECT k.*, c.last IS NOT NULL AND c.last <> k.doc_id AS gone FROM keyed AS k LEFT JOIN common AS c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op1_topk": """
        WITH sound AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, d.vec_id,
                list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * d.v[i]))::BIGINT AS score
            FROM sound AS q JOIN sound AS d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(q.v) = len(d.v))
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5""",
    "op3_mixing": rf"""
        WITH quality AS (SELECT doc_id AS k, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        rows AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(16**13)!r}::DOUBLE)
                    / CASE q WHEN 1 THEN {GOOD}::DOUBLE WHEN 0 THEN {BAD}::DOUBLE ELSE {UNKNOWN}::DOUBLE END AS draw
            FROM documents LEFT JOIN quality ON doc_id = k),
        sizes AS (SELECT source, sum(size)::BIGINT AS size FROM rows GROUP BY source),
        ranked AS (
            SELECT *, 3 * size AS cap,
                CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
                row_number() OVER (ORDER BY source NULLS LAST) AS rank
            FROM sizes),
        filling AS (
            SELECT *, ((SELECT sum(size) FROM ranked) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
            FROM ranked),
        aims AS (
            SELECT source, size AS source_size,
                CASE WHEN cap <= level * weight THEN cap::DOUBLE
                    ELSE (SELECT max(level) FROM filling WHERE NOT cap <= level * weight) * weight END AS target
            FROM filling),
        parts AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
                coalesce(sum(size) OVER (PARTITION BY rows.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM rows JOIN aims ON rows.source IS NOT DISTINCT FROM aims.source)
        SELECT doc_id, size, source_size, target,
            size * (epochs + CASE WHEN target - epochs * source_size > 0 AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS taken
        FROM parts""",
}
