"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from simgrove.llm.chat import op5_chat_tokens
from simgrove.llm.divergence import BINS, COMMON_WORDS, FLOOR, GUARD_WORDS, LIMIT_SHARE, LIMIT_WORDS, MAX_CHAR_DISTANCE, MIN_WORDS, NONE_WORDS, OTHER_LEAD, WORD_BINS, op3_language_divergence
from simgrove.llm.jaccard_join import op9_bayesian_jaccard
from simgrove.llm.kneser_ney import op7_kneser_ney
from simgrove.llm.packing import op4_best_fit_decreasing
from simgrove.llm.repair import op1_repair
from simgrove.llm.sharding import op10_weighted_hash_tree
from simgrove.llm.url_rules import op2_association_rules
from simgrove.llm.warc import op6_warc_revisits
from simgrove.llm.winnowing import op8_winnowing

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def queries() -> dict:
    return {
        "op1_repair": op1_repair,
        "op2_association_rules": op2_association_rules,
        "op3_language_divergence": op3_language_divergence,
        "op4_best_fit_decreasing": op4_best_fit_decreasing,
        "op5_chat_tokens": op5_chat_tokens,
        "op6_warc_revisits": op6_warc_revisits,
        "op7_kneser_ney": op7_kneser_ney,
        "op8_winnowing": op8_winnowing,
        "op9_bayesian_jaccard": op9_bayesian_jaccard,
        "op10_weighted_hash_tree": op10_weighted_hash_tree,
    }


def _op5() -> str:
    esc = r"(length({0}) + length({0}) - length(replace({0}, '\', '')) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda r: length(r) - 2)), 0))"
    return rf"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(15 + {esc.format('role')} + (length(role) - length(replace(role, ': ', ''))) // 2 + {esc.format('text')})::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""


def _op6() -> str:
    return """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    b AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (('0x' || substr(h, (i // 8 * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT & 31)::INT + 1, 1)), '') AS payload_digest,
      CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
    FROM p JOIN b USING (h)"""


def _op8() -> str:
    words = rf"list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, w[i:i + n - 1] AS g, n FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
    hit AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM dw) JOIN bw USING (n, g)),
    pos AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _op9() -> str:
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, text, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9
          UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.text = y.text AND x.doc_id <> y.doc_id),
    r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM d"""


def _op3() -> str:
    lists = "map {" + ", ".join(f"'{k}': {v}" for k, v in COMMON_WORDS.items()) + "}"
    classes = ["a-z", "A-Z", "0-9", r".,;:!?''\"()\-"]
    counts = [f"length(bare) - length(regexp_replace(bare, '[{c}]+', '', 'g'))" for c in classes]
    ascii_all = r"length(bare) - length(regexp_replace(bare, '[\x00-\x7F]+', '', 'g'))"
    shares = [f"({c}) / greatest(chars, 1)::DOUBLE" for c in [*counts, f"({ascii_all}) - ({' + '.join(f'({x})' for x in counts)})", f"length(bare) - ({ascii_all})"]]
    hits = "list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains(list, x))"
    words = [f"len(list_filter(hits, lambda x: x = list[{i + 1}])) / greatest(n, 1)::DOUBLE" for i in range(WORD_BINS - 1)] + ["(n - len(hits)) / greatest(n, 1)::DOUBLE"]
    cols = [(f"c{i}", x) for i, x in enumerate(shares)] + [(f"h{i}", x) for i, x in enumerate(words)]
    geo = ", ".join(f"exp(avg(ln({k} + {FLOOR})) FILTER (n >= {GUARD_WORDS})) AS g{k}" for k, _ in cols)

    def distance(kind, bins, own=None):
        total = "(" + " + ".join(f"r.g{kind}{i}" for i in range(bins)) + ")"
        term = lambda a, m: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ({m})) ELSE 0 END"
        parts = []
        for i in range(bins):
            p, q = f"x.{kind}{i}" if own is None else own[i], f"(r.g{kind}{i} / {total})"
            parts += [term(p, f"({p} + {q}) / 2"), term(q, f"({p} + {q}) / 2")]
        return f"CASE WHEN n >= {GUARD_WORDS} THEN sqrt(greatest(({' + '.join(parts)}) / 2, 0)) END"

    none = distance("h", WORD_BINS, ["0.0"] * (WORD_BINS - 1) + ["1.0"])
    known = sorted({x for v in COMMON_WORDS.values() for x in v})
    among = lambda a, b: f"len(list_filter(listed, lambda x: list_contains({[x for x in a if x not in b]}, x)))"
    lead = "CASE lang " + " ".join(f"WHEN '{o}' THEN greatest({', '.join(f'{among(v, mine)} - {among(mine, v)}' for k, v in COMMON_WORDS.items() if k != o)})" for o, mine in COMMON_WORDS.items()) + " END"
    return rf"""
    WITH a AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lower(lang) IN ('en', 'fr', 'de', 'es') THEN lower(lang) ELSE 'en' END AS lang FROM documents),
    b AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS bare FROM a),
    e AS (SELECT *, len(w) AS n, length(bare) AS chars, ({lists})[lang] AS list FROM b),
    f AS (SELECT *, {hits} AS hits, list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains({known}, x)) AS listed FROM e),
    x AS (SELECT doc_id, lang, n, chars, t, w, len(hits) AS n_hits, {lead} AS lead, {', '.join(f'{v} AS {k}' for k, v in cols)} FROM f),
    r AS (SELECT lang, {geo} FROM x GROUP BY lang),
    tri AS (SELECT doc_id, unnest(range(1, n - 1)) AS i, w FROM x WHERE n >= 3),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS k FROM tri) WHERE k > 1),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM rep) GROUP BY doc_id),
    y AS (SELECT x.*, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, {distance('c', BINS)} AS dc, {distance('h', WORD_BINS)} AS dh, {none} AS d0
      FROM x LEFT JOIN cov USING (doc_id) LEFT JOIN r USING (lang))
    SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, (n < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n) AS base_failed,
      round(dc, 6) AS char_distance, round(dh, 6) AS word_distance,
      NOT (n < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n) AND coalesce(dc <= {MAX_CHAR_DISTANCE}
      AND NOT ((n >= {LIMIT_WORDS} AND dh > {LIMIT_SHARE} * d0) OR (n >= {NONE_WORDS} AND n_hits = 0) OR lead >= {OTHER_LEAD}), true) AS kept FROM y"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over the whole tables. The other queries (ids of a tokenizer, crc32, a mined or trained model) are
    held against brute force in tests/llm."""
    return {"op3_language_divergence": _op3(), "op5_chat_tokens": _op5(), "op6_warc_revisits": _op6(), "op8_winnowing": _op8(), "op9_bayesian_jaccard": _op9()}
