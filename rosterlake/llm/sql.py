"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def _words(width: int) -> str:
    """words(doc_id, i, x) and windows(doc_id, i, q): each word and each window of `width` words by place."""
    ahead = " || ' ' || ".join(["x", *[f"lead(x, {k}) OVER o" for k in range(1, width)]])
    return rf"""
    d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS x FROM d),
    windows AS (SELECT * FROM (SELECT doc_id, i, {ahead} AS q FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE q IS NOT NULL)"""


OP3 = f"""WITH {_words(13)},
    first AS (SELECT q, min(doc_id) AS lo FROM windows GROUP BY q),
    gone AS (SELECT doc_id, i FROM windows JOIN first USING (q) WHERE lo < doc_id),
    marked AS (SELECT w.doc_id, w.i, x, max(CASE WHEN g.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS cut
               FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i),
    per AS (SELECT doc_id, sum(cut)::BIGINT AS n, string_agg(x, ' ' ORDER BY i) FILTER (WHERE cut = 0) AS kept FROM marked GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN per ON d.doc_id = per.doc_id"""

OP6 = rf"""WITH {_words(8)},
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, q) AS n FROM windows) WHERE n > 1),
    rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
    base AS (SELECT t.doc_id, t.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                    (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
             FROM documents t JOIN d ON t.doc_id = d.doc_id LEFT JOIN lines ON t.doc_id = lines.doc_id LEFT JOIN rep ON t.doc_id = rep.doc_id),
    failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
    host AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS f FROM failed GROUP BY source),
    moments AS (SELECT sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) AS m2 FROM host),
    prior AS (SELECT m, CASE WHEN m2 - m * m > 0 THEN least(1e6, greatest(1.0, m * (1 - m) / (m2 - m * m) - 1)) ELSE 1e6 END AS w FROM moments),
    rated AS (SELECT source, n + w AS weight, (f + m * w) / (n + w) AS rate, greatest(0.2, least(5 * m, m + 0.4 * (1 - m))) AS top FROM host, prior),
    verdict AS (SELECT source, rate, rate - 3 * sqrt(rate * (1 - rate) / (weight + 1)) <= top AS ok FROM rated)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept, round(rate, 6) AS host_rate FROM failed JOIN verdict ON failed.source IS NOT DISTINCT FROM verdict.source"""

OP7 = r"""WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           (7 + sum(16 + length(role) + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g'))))::BIGINT AS formatted_chars FROM r GROUP BY conv_id"""


#: crc(t): the table of CRC-32 (reflected, polynomial 0xEDB88320).
CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, beside the one row of crc."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), (2 * k + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))"


def _cell(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_LEAF = " || ".join(_cell(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_ALTERED = " || ".join(_cell(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))


def _levels(name: str, base: str) -> str:
    """All nodes over the leaves of `base`(tree, i, n, d): (tree, l, i, n, d)."""
    return f"""{name}(tree, l, i, n, d) AS (SELECT tree, 0, i, n, d FROM {base} UNION ALL
        SELECT tree, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, l, i // 2, n)"""


def _walk(name: str, base: str, nodes: str) -> str:
    """From the leaves of `base`(k, tree, i, n, d, proof) to the root: the fold of d and the siblings met."""
    return f"""{name}(k, tree, l, i, n, d, proof) AS (SELECT k, tree, 0, i, n, d, proof FROM {base} UNION ALL
        SELECT f.k, f.tree, f.l + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN f.i % 2 = 0 THEN f.d || coalesce(s.d, '') ELSE s.d || f.d END), f.proof || coalesce(s.d, '')
        FROM {name} f LEFT JOIN {nodes} s ON s.tree = f.tree AND s.l = f.l AND s.i = xor(f.i, 1) WHERE f.n > 1)"""


OP11 = f"""WITH RECURSIVE {CRC},
    raw AS (SELECT doc_id, lang, sha256({_LEAF}) AS d, CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 THEN sha256({_ALTERED}) END AS alt FROM documents, crc),
    leaf AS (SELECT row_number() OVER () AS k, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
                    count(*) OVER (PARTITION BY lang) AS n, doc_id, d, coalesce(alt, d) AS given, '' AS proof FROM raw),
    {_levels("forest", "leaf")},
    groups AS (SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, d FROM forest WHERE n = 1),
    {_levels("top", "groups")},
    root AS (SELECT d AS root FROM top WHERE n = 1),
    start AS (SELECT k, tree, i, n, given AS d, proof FROM leaf),
    {_walk("low", "start", "forest")},
    half AS (SELECT k, 0 AS tree, low.tree AS i, (SELECT count(*) FROM groups) AS n, d, proof FROM low WHERE n = 1),
    {_walk("high", "half", "top")}
    SELECT leaf.doc_id, leaf.d AS leaf, groups.d AS subroot, root, sha256(high.proof) AS proof_sha256, high.d AS folded_root, high.d = root AS verified
    FROM high JOIN leaf USING (k) JOIN groups ON groups.i = leaf.tree, root WHERE high.n = 1"""

_OP12_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12 = f"""WITH {CRC},
    d AS (SELECT row_number() OVER () AS k, doc_id, {_OP12_WORDS} AS w FROM documents),
    dw AS (SELECT k, x, count(*) AS c FROM (SELECT k, unnest(w) AS x FROM d) GROUP BY k, x),
    bw AS (SELECT x, count(*) AS c FROM (SELECT unnest({_OP12_WORDS}) AS x FROM benchmark) GROUP BY x),
    vocab AS (SELECT x, {_crc32('x')} % 10000 AS b FROM (SELECT DISTINCT x FROM dw UNION SELECT x FROM bw), crc),
    s AS (SELECT b, sum(c)::DOUBLE AS s FROM dw JOIN vocab USING (x) GROUP BY b),
    t AS (SELECT b, sum(c)::DOUBLE AS t FROM bw JOIN vocab USING (x) GROUP BY b),
    total AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS big_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS big_t),
    gain AS (SELECT s.b, floor(1000 * ln((coalesce(t, 0) + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (b), total),
    weight AS (SELECT k, sum(c * g)::BIGINT AS weight FROM dw JOIN vocab USING (x) JOIN gain USING (b) GROUP BY k),
    base AS (SELECT d.k, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weight USING (k)),
    drawn AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) OVER () AS n FROM base WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM base LEFT JOIN drawn USING (k)"""

#: Vectors that hold something, all components finite, are compared each with each: a form for small tables.
OP13 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS r FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.95),
    reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
    low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = low.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM low"""


def oracles() -> dict[str, str]:
    return {"op3_phrase_dedup": OP3, "op6_quality_rules": OP6, "op7_reply_trees": OP7, "op11_merkle_proofs": OP11, "op12_importance_draw": OP12, "op13_lattice_links": OP13}
