"""DuckDB SQL that states the results of this subpackage's queries, where SQL can. It compares words as texts, not hashes."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALPHANUMERIC = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SQL: dict[str, str] = {
    "op1_ngram_join": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 5, 0) + 2)) AS i FROM docs WHERE len(words) > 0),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM starts),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (shingle)
                   WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
                  WHERE 100 * c >= 80 * (x.n + y.n - c)),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id
        FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON a = doc_id GROUP BY doc_id""",
    "op3_phrase_index": f"""
        WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALPHANUMERIC}) AS words FROM documents),
        items AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALPHANUMERIC}) AS words FROM benchmark),
        item_starts AS (SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM items WHERE len(words) > 0),
        windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(words)) AS k,
                    array_to_string(words[i:i + 9], ' ') AS phrase FROM item_starts),
        doc_starts AS (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i
                       FROM docs JOIN (SELECT DISTINCT k FROM windows) ON k <= len(words)),
        found AS (SELECT doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM doc_starts
                  WHERE phrase IN (SELECT phrase FROM windows)),
        hit_places AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS place FROM found),
        hits AS (SELECT doc_id, count(*) AS n FROM hit_places GROUP BY doc_id),
        named AS (SELECT DISTINCT doc_id, item FROM found JOIN windows USING (phrase)),
        names AS (SELECT doc_id, count(item) AS n, string_agg(item, ',' ORDER BY item) AS joined FROM named GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items,
               sha256(coalesce(joined, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op10_suffix_automata": f"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM docs WHERE len(words) >= 50),
        windows AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS run FROM starts),
        firsts AS (SELECT run, min(doc_id) AS first_doc FROM windows GROUP BY run),
        covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place
                    FROM windows JOIN firsts USING (run) WHERE first_doc < doc_id),
        places AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS joined
                 FROM places ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(joined, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (doc_id)""",
    "op11_four_russians": r"""
        WITH RECURSIVE bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
                      FROM (SELECT unnest(range(256)) AS i)),
        crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
        keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        summed AS (SELECT keyed.*, xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(k[j])::BIGINT for j in range(1, length(k) + 1)]),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS d FROM keyed, crc),
        rows_ AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
                    unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM summed WHERE d <> 0),
        placed AS (SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body,
                     row_number() OVER w AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                     lag(role[1]) OVER w AS before
                   FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy)),
        faulty AS (SELECT *, role[1] AS c, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
                   FROM placed),
        facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                    count(*) FILTER (fault = 'truncated') AS truncated,
                    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
        steps AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra,
                    role || ':' || text AS own, 'user:' || text AS as_user, 'assistant:' || text AS as_assistant FROM faulty),
        -- Cheapest (cost, edits, text) on the way to each state, inserts before the next row included: nothing, after s, u and a.
        ways AS (SELECT conv_id, 0::BIGINT AS place, {'c': 0::BIGINT, 'a': '', 't': ''} AS x, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s,
                   {'c': 5::BIGINT, 'a': 'I', 't': chr(10) || 'user:'} AS u, {'c': 10::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a FROM facts
          UNION ALL
          SELECT conv_id, place, x, s, least(u, CASE WHEN s IS NOT NULL THEN {'c': s.c + 5, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'} END,
                     {'c': x.c + 5, 'a': x.a || 'I', 't': x.t || chr(10) || 'user:'}, {'c': a.c + 5, 'a': a.a || 'I', 't': a.t || chr(10) || 'user:'}) AS u,
                   least(a, {'c': u.c + 5, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}, {'c': x.c + 10, 'a': x.a || 'II', 't': x.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
                     CASE WHEN s IS NOT NULL THEN {'c': s.c + 10, 'a': s.a || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'} END) AS a
          FROM (SELECT w.conv_id, w.place + 1 AS place, {'c': x.c + 2, 'a': x.a || 'D', 't': x.t} AS x,
                  least(CASE WHEN s IS NOT NULL THEN {'c': s.c + 2, 'a': s.a || 'D', 't': s.t} END,
                    CASE WHEN NOT gone AND r.c = 's' THEN {'c': x.c + extra, 'a': x.a || 'K', 't': x.t || chr(10) || own} END) AS s,
                  least({'c': w.u.c + 2, 'a': w.u.a || 'D', 't': w.u.t},
                    CASE WHEN NOT gone AND r.c = 'u' THEN least({'c': x.c + extra, 'a': x.a || 'K', 't': x.t || chr(10) || own},
                      CASE WHEN s IS NOT NULL THEN {'c': s.c + extra, 'a': s.a || 'K', 't': s.t || chr(10) || own} END,
                      {'c': w.a.c + extra, 'a': w.a.a || 'K', 't': w.a.t || chr(10) || own}) END,
                    CASE WHEN NOT gone THEN least({'c': x.c + 1 + extra, 'a': x.a || 'R', 't': x.t || chr(10) || as_user},
                      CASE WHEN s IS NOT NULL THEN {'c': s.c + 1 + extra, 'a': s.a || 'R', 't': s.t || chr(10) || as_user} END,
                      {'c': w.a.c + 1 + extra, 'a': w.a.a || 'R', 't': w.a.t || chr(10) || as_user}) END) AS u,
                  least({'c': w.a.c + 2, 'a': w.a.a || 'D', 't': w.a.t},
                    CASE WHEN NOT gone AND r.c = 'a' THEN {'c': w.u.c + extra, 'a': w.u.a || 'K', 't': w.u.t || chr(10) || own} END,
                    CASE WHEN NOT gone THEN {'c': w.u.c + 1 + extra, 'a': w.u.a || 'R', 't': w.u.t || chr(10) || as_assistant} END) AS a
                FROM ways w JOIN steps r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.place = w.place + 1)),
        best AS (SELECT ways.conv_id, least(x, ways.a) AS b FROM ways JOIN facts ON ways.conv_id IS NOT DISTINCT FROM facts.conv_id WHERE place = n)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.t[2:], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM i.conv_id
        LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id""",
    "op12_bucket_pointers": """
        WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        pieces AS (SELECT doc_id, n, b, substr(h, 200 * b + 1, 400) AS piece FROM (SELECT *, unnest(range((n + 99) // 100)) AS b FROM docs)),
        windows AS (SELECT doc_id, 100 * b + o AS i, md5_number(substr(piece, 2 * o + 1, 200)) AS run
                    FROM (SELECT *, unnest(range(least(100, n - 99 - 100 * b))) AS o FROM pieces)),
        again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
        edges AS (SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM again),
        numbered AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM edges),
        spans AS (SELECT doc_id, span, min(i) AS first, max(i) + 100 AS last FROM numbered GROUP BY doc_id, span),
        gaps AS (SELECT doc_id, first, last, lag(last, 1, 0) OVER (PARTITION BY doc_id ORDER BY first) AS before FROM spans),
        cut AS (SELECT doc_id, count(*) AS n_spans, sum(last - first) AS n_removed, max(last) AS tail,
                  string_agg(substr(h, 2 * before + 1, 2 * (first - before)), '' ORDER BY first) AS head FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head || substr(h, 2 * tail + 1), h))) AS kept_sha256
        FROM docs LEFT JOIN cut USING (doc_id)""",
    "op13_hilbert_zones": """
        WITH whole AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                       FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        numbered AS (SELECT *, row_number() OVER () AS nr FROM whole),
        scored AS (SELECT a.nr AS anchor, a.vec_id AS anchor_id, b.nr AS other, b.vec_id AS id, a.label = b.label AS same,
                     list_dot_product(a.v, b.v)::BIGINT AS score
                   FROM numbered a JOIN numbered b ON a.vec_id % 100 = 0 AND a.nr <> b.nr AND len(a.v) = len(b.v)),
        positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.id)::INTEGER AS rank,
               n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        QUALIFY rank <= 10""",
}
