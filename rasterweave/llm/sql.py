"""The same results in plain SQL, for the queries that SQL can express."""

TILE = "CASE WHEN regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g') <> '' THEN lpad(regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '^T([0-9]{{1,2}}[A-Z]{{3}})$', '\\1'), 5, '0') END"

_STOCK = f"""
WITH a AS (SELECT DISTINCT poly_seq, {TILE.format("tile_id")} AS tile_id, upper(trim(pest_severity_code)) AS sev, CAST(labels AS VARCHAR) AS lab FROM annotations WHERE poly_seq IS NOT NULL),
held AS (SELECT poly_seq, tile_id, 'pest_severity_code' AS field_name, sev AS c FROM a UNION ALL SELECT poly_seq, tile_id, 'labels', lab FROM a),
stock AS (SELECT tile_id, field_name, c, count(DISTINCT poly_seq) AS stock FROM held WHERE c <> '' AND tile_id IS NOT NULL GROUP BY ALL),
t AS (SELECT t.*, greatest(coalesce(min_rows, 0), CAST(round(target_share * sample_size) AS BIGINT)) AS required, coalesce(s.stock, 0) AS stock FROM sample_targets t LEFT JOIN stock s ON s.tile_id = t.tile_id AND s.field_name = t.field_name AND s.c = upper(trim(t.category)))"""

_TERMS = """
WITH a AS (SELECT DISTINCT poly_seq, pest_species_code, tree_species_code, pest_severity_code FROM annotations WHERE poly_seq IS NOT NULL),
f AS (SELECT poly_seq, 'pest_species_code' AS field_name, upper(pest_species_code) AS x FROM a UNION ALL SELECT poly_seq, 'tree_species_code', upper(tree_species_code) FROM a UNION ALL SELECT poly_seq, 'pest_severity_code', upper(pest_severity_code) FROM a),
c AS (SELECT poly_seq, field_name, unnest(regexp_extract_all(x, '[\\p{L}\\p{Nd}]+')) AS code FROM f),
n AS (SELECT field_name, code, count(*) AS n_occurrences, count(DISTINCT poly_seq) AS n_records FROM c GROUP BY ALL),
m AS (SELECT *, CASE WHEN n_records < 5 THEN 'rare' WHEN n_records > (SELECT count(DISTINCT poly_seq) FROM annotations) / 10 THEN 'common' END AS mark FROM n)"""

# The characters whose look is changed by one-to-one translation after composition; same order in both.
_FROM = "ΑАΒВϹСΕЕΗНΙІЈΚКΜМΝΟОΡРЅΤТΧХΥҮΖԚԜаɑсϲԁеɡһіјоορрԛѕνѵԝхуЁёόΌΈΊΎΪЇїГПФµ"
_TO = "AABBCCEEHHIIJKKMMNOOPPSTTXXYYZQWaaccdeghijooppqsvvwxyËëóÓÉÍÝÏÏïΓΠΦμ"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_SPACES = "".join(chr(c) for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))
_HIDDEN = r"[\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
_LOOK = f"nfc_normalize(replace(replace(translate(nfc_normalize(translate(regexp_replace(text, '{_HIDDEN}', '', 'g'), '{_WIDE}{_SPACES}', '{_NARROW}{' ' * len(_SPACES)}')), '{_FROM}', '{_TO}'), 'Ή', 'H' || chr(769)), 'Ά', 'Á'))"

ORACLE = {
    "p2_found": f"{_STOCK} SELECT draw_id, category FROM t WHERE stock < required",
    "p2_report": f"{_STOCK}, d AS (SELECT *, least(stock, required) AS drawn FROM t) SELECT draw_id, category, required, stock, drawn, round(drawn / nullif(sum(drawn) OVER (PARTITION BY draw_id), 0), 6) AS share, drawn < required AS short FROM d",
    "p2_sample": f"""{_STOCK}, g AS (SELECT draw_id, tile_id, field_name, upper(trim(category)) AS c, max(required) AS required FROM t WHERE upper(trim(category)) <> '' GROUP BY ALL),
r AS (SELECT g.draw_id, g.c, g.required, h.poly_seq, CAST('0x' || substr(md5('42:' || g.draw_id || ':' || h.poly_seq), 1, 15) AS BIGINT) AS priority FROM g JOIN held h ON h.tile_id = g.tile_id AND h.field_name = g.field_name AND h.c = g.c)
SELECT draw_id, c AS category, poly_seq FROM r QUALIFY row_number() OVER (PARTITION BY draw_id, c ORDER BY priority, poly_seq) <= required""",
    "p3_found": f"{_TERMS} SELECT field_name, code, mark FROM m WHERE mark IS NOT NULL",
    "p3_terms": f"{_TERMS} SELECT field_name, code, n_occurrences, n_records, mark FROM m",
    "p5_found": f"""
WITH i AS (SELECT image_id, min({TILE.format("tile_id")}) AS tile_id FROM image_catalog GROUP BY image_id),
c AS (SELECT DISTINCT cube_id, image_id, {TILE.format("tile_id")} AS tile_id, capture_year, lower(trim(split)) AS s FROM cubes),
k AS (SELECT cube_id, coalesce(c.tile_id, i.tile_id) AS tile_id, capture_year, CASE WHEN s IN ('train', 'training') THEN 'train' WHEN s IN ('val', 'validation') THEN 'val' WHEN s IN ('test', 'testing') THEN 'test' END AS s FROM c LEFT JOIN i USING (image_id))
SELECT tile_id, capture_year FROM k WHERE tile_id IS NOT NULL AND capture_year IS NOT NULL GROUP BY ALL HAVING count(DISTINCT s) > 1""",
    "p5_report": "SELECT split AS assigned_split, (SELECT count(DISTINCT cube_id) FROM cubes) AS n_cubes, true AS near, 0 AS divided FROM split_targets",
    "p5_groups": """
WITH RECURSIVE k AS (SELECT doc_id, 'b' || bitext_id AS key FROM documents WHERE trim(bitext_id) <> '' UNION ALL SELECT doc_id, 's' || text FROM documents WHERE trim(text) <> '' UNION ALL SELECT doc_id, 't' || tgt_text FROM documents WHERE trim(tgt_text) <> ''),
h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS hub FROM k),
e AS (SELECT doc_id AS a, hub AS b FROM h WHERE doc_id <> hub UNION SELECT hub, doc_id FROM h WHERE doc_id <> hub),
r AS (SELECT doc_id AS root, doc_id FROM documents UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.doc_id),
g AS (SELECT doc_id, min(root) AS first_doc FROM r GROUP BY doc_id)
SELECT doc_id, first_doc, count(*) OVER (PARTITION BY first_doc) AS n_docs FROM g""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_report": "SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS n_items, 0 AS divided, 0 AS overfull, true AS filled FROM pack_sizes",
    "p8_found": f"WITH l AS (SELECT doc_id, text, {_LOOK} AS look FROM documents WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM l a JOIN l b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p8_classes": f"""WITH l AS (SELECT doc_id, text, {_LOOK} AS look FROM documents WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
m AS (SELECT doc_id, count(*) OVER (PARTITION BY look) AS n, count(*) OVER (PARTITION BY look, text) AS same, min(doc_id) OVER (PARTITION BY look) AS look_class FROM l)
SELECT doc_id, look_class, n AS n_members, n - same AS n_links FROM m WHERE n > same""",
    "p8_canonical": f"SELECT doc_id, {_LOOK} AS text FROM documents",
}
