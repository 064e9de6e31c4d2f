"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

#: A-Z lower-cased, null as empty.
_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_NORM)


def _license_sql() -> str:
    """Phrases and templates are the operator's fixed lists, written out as words here."""
    from .license_scan import DRIFT, ENOUGH, NEAR, PHRASES, TEMPLATES, VOTED

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {str(i < len(PHRASES)).lower()}, {quoted(label)}, {quoted(text.lower())})" for i, (label, text) in enumerate([*PHRASES, *TEMPLATES]))
    words_of_t = _WORDS.replace("coalesce(text, '')", "t")
    code = "array_to_string(list_transform({}, lambda w: chr(48 + coalesce(list_position(tw, w), 0)::INT)), '')"
    return f"""
        WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        forms AS (SELECT id, phrase, label, {words_of_t} AS tw FROM (VALUES {rows}) v(id, phrase, label, t)),
        tg AS (SELECT id, phrase, len(tw) - 1 AS grams, k, tw[k] AS a, tw[k + 1] AS b FROM (SELECT *, unnest(range(1, len(tw))) AS k FROM forms)),
        dg AS (SELECT doc_id, k, words[k] AS a, words[k + 1] AS b FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS k FROM docs)),
        diag AS (SELECT doc_id, id, phrase, grams, dg.k - tg.k AS diagonal, list(DISTINCT tg.k) AS ks, min(dg.k) AS lo, max(dg.k) AS hi
                 FROM dg JOIN tg USING (a, b) GROUP BY ALL),
        steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > {NEAR} THEN 1 ELSE 0 END AS step
                  FROM diag WHERE NOT phrase WINDOW w AS (PARTITION BY doc_id, id ORDER BY diagonal)),
        runs AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, id ORDER BY diagonal) AS run FROM steps),
        cand AS (SELECT x.doc_id, x.id, x.grams, x.diagonal, min(y.lo) AS lo, max(y.hi) + 1 AS hi, len(list_distinct(flatten(list(y.ks)))) AS voted
                 FROM runs x JOIN runs y ON x.doc_id = y.doc_id AND x.id = y.id AND x.run = y.run AND y.diagonal BETWEEN x.diagonal AND x.diagonal + {DRIFT}
                 GROUP BY x.doc_id, x.id, x.grams, x.diagonal HAVING voted >= {VOTED} * x.grams),
        spelt AS (SELECT cand.*, label, {code.format("words[lo:hi]")} AS s, {code.format("tw")} AS o
                  FROM cand JOIN docs ON cand.doc_id = docs.doc_id JOIN forms ON cand.id = forms.id),
        good AS (SELECT *, 1.0::DOUBLE - levenshtein(s, o) / greatest(length(s), length(o)) AS share FROM spelt),
        reach AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto
                  FROM good WHERE share >= {ENOUGH}),
        isles AS (SELECT *, sum(CASE WHEN lo < upto THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY lo, hi, id ROWS UNBOUNDED PRECEDING) AS isle FROM reach),
        best AS (SELECT * FROM isles QUALIFY row_number() OVER (PARTITION BY doc_id, isle ORDER BY share DESC, voted / grams DESC, grams DESC, id, diagonal) = 1),
        hits AS (SELECT doc_id, label, diagonal AS pos, 1.0::DOUBLE AS share, true AS base FROM diag JOIN forms USING (id) WHERE diag.phrase AND len(ks) = grams
                 UNION ALL SELECT doc_id, label, NULL, share, false FROM best),
        agg AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
                       string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                       string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
                FROM hits GROUP BY doc_id)
        SELECT d.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM docs d LEFT JOIN agg ON d.doc_id = agg.doc_id
    """


LLM_ORACLE: dict[str, str] = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)
    """,
    "op3_suffix_dedup": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), w AS (
            SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS win
            FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)
        ), gone AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM w) WHERE n > 1
        ), reach AS (
            SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM gone
        ), marked AS (
            SELECT doc_id, i, sum(CASE WHEN upto >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM reach
        ), spans AS (
            SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM marked GROUP BY doc_id, span
        ), gaps AS (
            SELECT doc_id, span, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM spans
        ), cut AS (
            SELECT g.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed,
                   string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
            FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id
        )
        SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
    """,
    "op8_cover_anchors": """
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
        ), w AS (
            SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13)
        ), gone AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM w) WHERE least < doc_id
        ), cut AS (
            SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM gone) GROUP BY doc_id
        )
        SELECT d.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
               sha256(array_to_string(CASE WHEN places IS NULL THEN words
                   ELSE list_transform(list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(places, p)), lambda p: words[p]) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
    """,
    "op5_license_diagonals": _license_sql(),
    "op6_positional_index": f"""
        WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        items AS (SELECT item_id, {_WORDS} AS iw FROM benchmark),
        ph AS (SELECT DISTINCT item_id, array_to_string(iw[k:k + 12], ' ') AS win, least(len(iw), 13) AS n
               FROM (SELECT item_id, iw, unnest(range(1, greatest(len(iw) - 12, 1) + 1)) AS k FROM items WHERE len(iw) > 0)),
        sizes AS (SELECT DISTINCT n FROM ph),
        dw AS (SELECT doc_id, n, k, array_to_string(words[k:k + n - 1], ' ') AS win
               FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM docs, sizes)),
        m AS (SELECT doc_id, item_id, k, ph.n FROM dw JOIN ph ON dw.n = ph.n AND dw.win = ph.win),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
        own AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
        , forms AS (SELECT row_number() OVER (ORDER BY win) AS ph, win, string_split(win, ' ') AS ts, n FROM (SELECT DISTINCT win, n FROM ph)),
        pt AS (SELECT ph, n, o, ts[o] AS term FROM (SELECT ph, n, ts, unnest(range(1, n + 1)) AS o FROM forms)),
        mv AS (SELECT DISTINCT doc_id, ph, n, o, k - o AS d FROM (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS k FROM docs) w JOIN pt USING (term)),
        whole AS (SELECT doc_id, ph FROM mv GROUP BY doc_id, ph, n HAVING count(DISTINCT o) = n),
        close AS (SELECT DISTINCT doc_id, ph FROM (SELECT doc_id, ph, d - j AS s FROM mv JOIN whole USING (doc_id, ph), range(0, 2 + 1) r(j)
                  GROUP BY doc_id, ph, n, s HAVING count(DISTINCT o) = n)),
        nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN forms USING (ph) JOIN ph USING (win) GROUP BY doc_id)
        SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated, coalesce(n_near, 0) AS n_near
        FROM docs d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN own ON d.doc_id = own.doc_id LEFT JOIN nears ON d.doc_id = nears.doc_id
    """,
    "op9_bayes_near_join": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda k: array_to_string(words[k:k + 4], ' ')))) AS s
                 FROM docs WHERE len(words) > 0),
        sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
                  FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b, c = na AND c = nb AS same FROM pairs WHERE 10 * c >= 8 * (na + nb - c)),
        reach AS (SELECT doc_id, doc_id AS r FROM docs UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
        cls AS (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY doc_id),
        deg AS (SELECT a, count(*) AS n_links, count(*) FILTER (same) AS same FROM links GROUP BY a)
        SELECT cls.doc_id, class_id, coalesce(same, 0) + 1 AS n_copies, coalesce(n_links, 0) AS n_links
        FROM cls LEFT JOIN deg ON cls.doc_id = deg.a
    """,
    "op11_kronecker_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
                   coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
            FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER w::INT AS rank, n.vec_id AS negative_id,
               p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
}
