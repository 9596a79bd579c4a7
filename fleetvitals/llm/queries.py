"""The registered queries: each operator on its whole table, and the digest columns it is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvitals.llm import best_fit_pack as op9
from fleetvitals.llm import chunk_recipes as op4
from fleetvitals.llm import count_rtree_join as op5
from fleetvitals.llm import language_id as op6
from fleetvitals.llm import license_scan as op1
from fleetvitals.llm import line_chunks as op10
from fleetvitals.llm import lsa_decontam as op8
from fleetvitals.llm import merkle_manifest as op12
from fleetvitals.llm import token_shards as op2
from fleetvitals.llm import pii_disclosure as op13
from fleetvitals.llm import prefix_trie as op11
from fleetvitals.llm import toxicity_chain as op7
from fleetvitals.llm import warc_zst as op3
from fleetvitals.llm._scratch import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.summary(op1.license_scan(table(spark, sf_dir, "documents"))).drop("detections")


def word_tokenizer() -> str:
    """Path of the tokenizer file that the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.round_trip(table(spark, sf_dir, "documents"), word_tokenizer())


def op3_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op3.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.exact_groups(table(spark, sf_dir, "documents"))


def op5_count_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.ngram_join(table(spark, sf_dir, "documents")).drop("_llm_hash", "_llm_component")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = "crc32(coalesce(cast(doc_id as string), '')) % 4"
    model = op6.fit(docs, f"{fold} <> 2")
    found = op6.predict(docs, model)
    return found.select("doc_id", F.expr(f"{fold} = 2").alias("held_out"), "lang_pred", "score")


#: What the table labels. A document of low quality is the first category, a toxic one the last.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> op7.Model:
    return op7.fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = op7.probabilities(docs, toxicity_model(spark, docs, sf_dir))
    return found.withColumn("toxic", F.col("p_toxic") >= op7.THRESHOLD)


def op8_lsa_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.try_element_at("found", F.lit(1))
    return found.select(
        "doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("bigint").alias("n_items"),
        best["item"].cast("bigint").alias("item_id"), *(best[c].alias(c) for c in ("share", "cosine", "first_word", "last_word")),
        F.transform("found", lambda x: x["item"].cast("bigint")).alias("item_ids"),
    )


def op9_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.line_dedup(table(spark, sf_dir, "documents"), detail=True)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = op11.turns_of(table(spark, sf_dir, "conversations"))
    taken = F.crc32(F.col("conv_id").cast("string")) % 9
    return op11.trie(op11.rebuilt(own, F.col("conv_id") - F.col("conv_id") % 5, taken))


#: The columns of a leaf, in their order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = [F.translate(c, CAPITALS, SMALL) if c == "text" else F.col(c) for c in LEAF]
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, op12.leaf(changed))
    found = op12.manifest(docs, "doc_id", "lang", LEAF, claim)
    return found.select("doc_id", "leaf", "subroot", "root", op12.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op13_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op13.find(docs, op13.fit(docs))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_token_shards, op3_warc_zst, op4_chunk_recipes, op5_count_rtree_join,
        op6_language_id, op7_toxicity_chain, op8_lsa_decontam, op9_best_fit_pack, op10_line_chunks,
        op11_prefix_trie, op12_merkle_manifest, op13_pii_disclosure,
    )
}



def _crc32(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {bit})"
    bytes_ = f"list_transform(string_split({value}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda a, b: {byte}), 4294967295)"


def _merkle(text: str) -> str:
    parts = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in LEAF]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


ORACLE = {
    "op3_warc_zst": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
        first AS (SELECT html, min(page_id) AS least FROM p GROUP BY html)
        SELECT d.page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN d.page_id IS DISTINCT FROM least AND least IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN d.page_id IS DISTINCT FROM least THEN least END AS refers_to
        FROM d JOIN first USING (html)""",
    "op4_chunk_recipes": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op11_prefix_trie": f"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
          SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, left(sha256(strlen(role) || ':' || role || text), 32)) AS turns,
                 ({_crc32("CAST(conv_id AS VARCHAR)")} % 9)::INTEGER AS h
          FROM t GROUP BY conv_id),
        convs AS (
          SELECT own.conv_id, list_concat(coalesce(list_slice(base.turns, 1, own.h), []), list_slice(own.turns, own.h + 1, len(own.turns))) AS turns
          FROM own LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 5),
        members AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM convs),
        nodes AS (
          SELECT list_slice(turns, 1, depth) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
          FROM members GROUP BY 1, 2),
        kids AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        own_part AS (
          SELECT nodes.*, coalesce(n_children, 0) AS n_children,
                 CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(nodes.p[nodes.depth].text) END AS saved
          FROM nodes LEFT JOIN kids ON nodes.p = kids.p),
        climbed AS (SELECT p, unnest(range(0, depth + 1)) AS k, n_children, saved FROM own_part),
        sums AS (
          SELECT list_slice(p, 1, k) AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
          FROM climbed GROUP BY 1)
        SELECT o.conv_id, o.depth, parent.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, o.ends_sha256
        FROM own_part o JOIN sums ON sums.p = o.p
        LEFT JOIN nodes parent ON o.depth > 0 AND parent.p = list_slice(o.p, 1, o.depth - 1)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
          SELECT doc_id, lang, coalesce('=' || lang, '-') AS g, {_merkle("text")} AS leaf,
                 CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_merkle(f"translate(text, '{CAPITALS}', '{SMALL}')")} ELSE {_merkle("text")} END AS claim
          FROM documents),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS row FROM leaves),
        low(g, level, i, node, n) AS (
          SELECT g, 0, i, leaf, count(*) OVER (PARTITION BY g) FROM placed
          UNION ALL
          SELECT g, level + 1, i, node, count(*) OVER (PARTITION BY g) FROM (
            SELECT g, level, i // 8 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node FROM low WHERE n > 1 GROUP BY g, level, i // 8)),
        subroots AS (
          SELECT g, node AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS k FROM low WHERE n = 1),
        high(level, i, node, n) AS (
          SELECT 0, k, subroot, count(*) OVER () FROM subroots
          UNION ALL
          SELECT level + 1, i, node, count(*) OVER () FROM (
            SELECT level, i // 8 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node FROM high WHERE n > 1 GROUP BY level, i // 8)),
        top AS (SELECT node AS root, level AS height FROM high WHERE n = 1),
        runs AS (
          SELECT p.row, low.level AS step,
                 coalesce(string_agg(node, '' ORDER BY low.i) FILTER (low.i < p.i >> (3 * low.level)), '') AS l,
                 coalesce(string_agg(node, '' ORDER BY low.i) FILTER (low.i > p.i >> (3 * low.level)), '') AS r
          FROM placed p JOIN low ON p.g = low.g AND low.n > 1 AND low.i >> 3 = p.i >> (3 * low.level + 3) GROUP BY 1, 2
          UNION ALL
          SELECT p.row, s.height + high.level,
                 coalesce(string_agg(node, '' ORDER BY high.i) FILTER (high.i < s.k >> (3 * high.level)), ''),
                 coalesce(string_agg(node, '' ORDER BY high.i) FILTER (high.i > s.k >> (3 * high.level)), '')
          FROM placed p JOIN subroots s USING (g) JOIN high ON high.n > 1 AND high.i >> 3 = s.k >> (3 * high.level + 3) GROUP BY 1, 2),
        proofs AS (SELECT row, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM runs GROUP BY row),
        folds(row, step, node) AS (
          SELECT row, 0, claim FROM placed
          UNION ALL
          SELECT f.row, f.step + 1, sha256(l || node || r) FROM folds f JOIN runs ON runs.row = f.row AND runs.step = f.step),
        folded AS (SELECT row, arg_max(node, step) AS node FROM folds GROUP BY row)
        SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
        FROM placed p JOIN subroots USING (g) CROSS JOIN top JOIN folded f ON f.row = p.row LEFT JOIN proofs ON proofs.row = p.row""",
}
