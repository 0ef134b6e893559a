"""The registered queries of the operators, over whole tables, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.llm import decontaminate, embeddings, language, line_dedup, merkle, minhash, mixture, periodic, quality, rows, secret_scan, substrings, token_ids, toxicity

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def tokenizer_path() -> str:
    """Place of the public vocabulary file that the queries take."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_files(_texts(spark, sf_dir), tokenizer_path(), END_ID)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(_texts(spark, sf_dir), 13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_texts(spark, sf_dir), size=2, percent=80)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, (n_words, spans, items) = decontaminate.contamination(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        decontaminate.hit_words(F.col(spans)).alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col(n_words), F.col(spans)).alias("contaminated"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.prototypes(docs.filter(rows.crc_bucket("doc_id", 4) != 2))
    found, (lang, score) = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (rows.crc_bucket("doc_id", 4) == 2).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _scored(found: DataFrame, score: str, at: float) -> DataFrame:
    predicted = (F.col(score) >= at).cast("int")
    return found.select("doc_id", (rows.crc_bucket("doc_id", 5) == 0).alias("held_out"), F.col(score).alias("score"), predicted.alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    model = quality.learn_quality(docs, _table(spark, sf_dir, "labels"), rows.crc_bucket("doc_id", 5) != 0)
    found, (score,) = quality.score_quality(docs, model)
    return _scored(found, score, 0.3)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    model = toxicity.learn_toxicity(docs, _table(spark, sf_dir, "labels"), rows.crc_bucket("doc_id", 5) != 0)
    found, (score,) = toxicity.score_toxicity(docs, model)
    return _scored(found, score, 0.5)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    network = secret_scan.train(*secret_scan.own_findings(docs))
    found, (name,) = secret_scan.scan(docs, network)
    count = lambda kind: F.size(F.filter(name, lambda f: f["kind"] == kind)).cast("bigint")
    written = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter(name, lambda f: f["kind"] != "network")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col(name)).alias("spans"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, (n_lines, n_dropped, kept) = line_dedup.without_common_lines(_texts(spark, sf_dir), min_docs=10, min_chars=1)
    return found.select("doc_id", n_lines, n_dropped, F.sha2(F.col(kept).cast("binary"), 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(rows.crc_bucket("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(merkle.leaves(_table(spark, sf_dir, "documents"), tampered))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth text, by crc32 of its id, runs on periodically from one of its words."""
    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(code % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    chosen = tx.pinned(docs, _words=words)
    g, n = F.floor(code / 10), F.size("_words")
    a = g % n
    period = 1 + F.floor((n - a) / (3 + g % 8))
    placed = tx.pinned(chosen, _a=F.when(n > 0, a).cast("int"), _p=F.when(n > 0, period).cast("int"))
    turned = F.transform("_words", lambda x, i: F.when(i < F.col("_a"), x).otherwise(F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, (name, collapsed) = periodic.with_runs(planted_runs(_texts(spark, sf_dir)))
    longest = F.array_max(F.transform(name, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform(name, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size(name).cast("bigint").alias("n_runs"),
        (-longest["start"]).alias("start"),
        longest["length"].alias("length"),
        (-longest["period"]).alias("period"),
        F.floor(1000 * longest["length"] / -longest["period"]).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col(collapsed).cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_substring_dedup, op3_minhash_dedup, op4_decontamination, op5_embedding_dedup, op6_language_id, op7_mixture, op8_quality, op9_toxicity, op10_secret_scan, op11_line_dedup, op12_merkle_manifest, op13_periodic_runs)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 of a doc_id in decimal, a step per bit; a byte is mixed in before its eight steps.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(doc_id AS varchar), '')])),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END))"""
_LEAF = lambda text: "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS varchar)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_PARENTS = "[sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')) for i in range((len(nodes) + 2) // 3)]"
_SIDES = "array_to_string(nodes[p // 3 * 3 + 1:p], '') AS before, array_to_string(nodes[p + 2:p // 3 * 3 + 3], '') AS after"

#: The contracts stated plainly, by joins on the words themselves; what a model, a tokenizer or a draw decides is not SQL.
CHECK_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
      places AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
      earliest AS (SELECT g, min(doc_id) AS lead FROM places GROUP BY g),
      gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM places JOIN earliest USING (g) WHERE doc_id > lead),
      single AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
      kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM single ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
      SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op3_minhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), least(len(ws), 1) + 1))) AS i FROM w WHERE len(ws) > 0)),
      n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
      p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
      link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.k + y.k - c)),
      step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
      reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, step.b FROM reach JOIN step ON reach.r = step.a)
      SELECT doc_id, coalesce(max(k), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op4_decontamination": f"""WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS ws FROM documents),
      b AS (SELECT item_id, {_ALNUM_WORDS} AS ws FROM benchmark),
      wanted AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (
        SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
      places AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (
        SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wanted) WHERE len(ws) >= n)),
      met AS (SELECT doc_id, i, n, item_id FROM places JOIN wanted USING (n, g)),
      hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
      items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM met) GROUP BY doc_id)
      SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS double[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
      u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
      link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.93),
      reach(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.r = link.a),
      n AS (SELECT a AS vec_id, count(*) AS k FROM link GROUP BY a)
      SELECT vec_id, coalesce(max(k), 0) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id""",
    "op11_line_dedup": """WITH l AS (SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
      common AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
      SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.k IS NULL), '')) AS kept_sha256
      FROM l LEFT JOIN common USING (k) GROUP BY doc_id""",
    "op12_merkle_manifest": f"""WITH RECURSIVE leaf AS (SELECT doc_id, source, {_LEAF("text")} AS leaf,
        CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF("text")} END AS claimed FROM documents),
      placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM leaf),
      trees(source, lvl, nodes) AS (SELECT source, 0, list(leaf ORDER BY pos) FROM placed GROUP BY source
        UNION ALL SELECT source, lvl + 1, {_PARENTS} FROM trees WHERE len(nodes) > 1),
      tops AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos, lvl AS height FROM trees WHERE len(nodes) = 1),
      crown(lvl, nodes) AS (SELECT 0, list(subroot ORDER BY spos) FROM tops UNION ALL SELECT lvl + 1, {_PARENTS} FROM crown WHERE len(nodes) > 1),
      steps AS (SELECT doc_id, lvl, {_SIDES} FROM (SELECT doc_id, lvl, nodes, CAST(pos // CAST(pow(3, lvl) AS bigint) AS bigint) AS p FROM placed x JOIN trees t ON t.source IS NOT DISTINCT FROM x.source WHERE len(nodes) > 1)
        UNION ALL SELECT doc_id, height + lvl, {_SIDES} FROM (SELECT doc_id, height, lvl, nodes, CAST(spos // CAST(pow(3, lvl) AS bigint) AS bigint) AS p FROM placed x JOIN tops t ON t.source IS NOT DISTINCT FROM x.source, crown WHERE len(nodes) > 1)),
      paths AS (SELECT doc_id, list({{'before': before, 'after': after}} ORDER BY lvl) AS path FROM steps GROUP BY doc_id),
      fold(doc_id, step, node) AS (SELECT doc_id, 1, claimed FROM placed
        UNION ALL SELECT fold.doc_id, step + 1, sha256(path[step].before || node || path[step].after) FROM fold JOIN paths ON fold.doc_id = paths.doc_id WHERE step <= len(path))
      SELECT x.doc_id, leaf, subroot, root, sha256(array_to_string([s.before || s.after for s in coalesce(path, [])], '')) AS proof_sha256, node AS folded_root, node = root AS verified
      FROM placed x JOIN tops t ON t.source IS NOT DISTINCT FROM x.source LEFT JOIN paths ON x.doc_id = paths.doc_id
      JOIN fold ON fold.doc_id = x.doc_id AND step = coalesce(len(path), 0) + 1, (SELECT nodes[1] AS root FROM crown WHERE len(nodes) = 1)""",
    "op13_periodic_runs": f"""WITH c AS (SELECT doc_id, {_WORDS} AS ws, {_CRC} AS h FROM documents),
      d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN [ws[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS int) + 1] for i in range(len(ws))] ELSE ws END AS ws
        FROM (SELECT *, 1 + (len(ws) - a) // (3 + (h // 10) % 8) AS p FROM (SELECT *, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a FROM c))),
      word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
      pair AS (SELECT x.doc_id, y.i - x.i AS q, y.i AS j FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
      island AS (SELECT doc_id, q, min(j) - q AS a, max(j) AS b FROM (SELECT *, j - row_number() OVER (PARTITION BY doc_id, q ORDER BY j) AS part FROM pair) GROUP BY doc_id, q, part),
      run AS (SELECT doc_id, a AS start, b - a + 1 AS length, min(q) AS period FROM island WHERE b - a + 1 >= greatest(12, 2 * q) GROUP BY doc_id, a, b),
      gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
      kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
      told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t,
        first({{'s': start, 'l': length, 'p': period}} ORDER BY length DESC, start, period) AS top FROM run GROUP BY doc_id)
      SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, 1000 * top.l // top.p AS exponent_milli,
        sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256 FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
