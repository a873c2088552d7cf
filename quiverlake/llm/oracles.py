"""DuckDB SQL for the corpus queries that SQL can express, written from their contracts and not from their methods."""

from __future__ import annotations

from .licenses import LEAST, SHINGLE, TEMPLATES, chunks, shingles

TOP_K = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20"""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def near_duplicates(width: int, percent: int) -> str:
    """Sets of word shingles, all pairs that share one, and the transitive closure of the links."""
    words = _WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, coalesce({words}, []) AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[k:k + least({width}, len(words)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {width}, 0) + 2)) AS k FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT a AS node, a AS seen FROM link UNION SELECT node, b FROM reach JOIN link ON seen = a),
least_ AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON node = doc_id"""


def substrings(width: int = 20) -> str:
    """Every window by its words, and the words that a repeated one covers."""
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS words FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, k, array_to_string(words[k:k + {width - 1}], ' ') AS same
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {width} + 2)) AS k FROM w WHERE len(words) >= {width})),
first AS (SELECT same, min({{'doc': doc_id, 'k': k}}) AS head FROM win GROUP BY same HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + {width})) AS place FROM win JOIN first USING (same) WHERE head <> {{'doc': doc_id, 'k': k}}),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def licenses() -> str:
    """Windows that meet a shingle of a chunk, and the share of the chunk's shingles that each holds."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    known = chunks(TEMPLATES)
    rows = ", ".join(f"({quoted(t)}, {k}, {len(w)}, {min(SHINGLE, len(w))}, {quoted(s)})" for t, k, w in known for s in shingles(w))
    return f"""
WITH want(template, chunk, size, width, shingle) AS (VALUES {rows}),
total AS (SELECT template, chunk, count(*) AS wanted FROM want GROUP BY ALL),
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents WHERE text IS NOT NULL),
have AS MATERIALIZED (
  SELECT doc_id, len(words) AS n, k, width, array_to_string(words[k:k + width - 1], ' ') AS shingle
  FROM (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS k FROM w, (SELECT DISTINCT width FROM want))),
hit AS MATERIALIZED (SELECT DISTINCT doc_id, n, k - 1 AS k, template, chunk, size, want.width, shingle FROM have JOIN want USING (shingle, width)),
start AS (SELECT DISTINCT doc_id, n, template, chunk, size, width, unnest(range(greatest(k - size + width, 0), k + 1)) AS s FROM hit),
win AS (SELECT * FROM start WHERE s = 0 OR s + size <= n),
share AS (
  SELECT win.doc_id, win.template, win.chunk, s, count(DISTINCT shingle) AS c FROM win
  JOIN hit ON hit.doc_id = win.doc_id AND hit.template = win.template AND hit.chunk = win.chunk AND hit.k BETWEEN s AND s + win.size - win.width GROUP BY ALL),
good AS (SELECT *, CAST(c AS DOUBLE) / wanted AS containment FROM share JOIN total USING (template, chunk) WHERE CAST(c AS DOUBLE) / wanted >= {LEAST})
SELECT doc_id, template, CAST(chunk AS INTEGER) AS chunk, max(containment) AS containment, CAST(arg_min(s, {{'c': -containment, 's': s}}) AS INTEGER) AS start_word, count(*) AS n_windows
FROM good GROUP BY doc_id, template, chunk"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decontamination(width: int = 10) -> str:
    """Every window of every document against the windows of the items, by their words."""
    words = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, {words} AS words FROM documents),
b AS (SELECT item_id, {words} AS words FROM benchmark),
iw AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(words[k:k + size - 1], ' ') AS win
  FROM (SELECT item_id, words, least({width}, len(words)) AS size, unnest(range(1, len(words) - least({width}, len(words)) + 2)) AS k FROM b WHERE len(words) > 0)),
dw AS (SELECT doc_id, k, size, array_to_string(words[k:k + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM w, (SELECT DISTINCT size FROM iw) WHERE len(words) >= size)),
met AS MATERIALIZED (SELECT DISTINCT doc_id, k, size, item_id FROM dw JOIN iw USING (win, size)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def lexical(k: int = 50) -> str:
    """Every posting of every item's terms, summed up."""
    terms = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, unnest({terms}) AS term FROM documents WHERE text IS NOT NULL),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
m AS MATERIALIZED (SELECT doc_id, 100 - 50 + (50 * n * docs) // words AS m FROM n, total),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
item AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM item JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""


def spelling(least: int = 5, seen: int = 3, ratio: int = 2, noise: int = 97) -> str:
    """crc32 by its table, near words by keys with a code point left out or blotted out, forms followed by recursion."""
    from .spelling import CRC

    table = "[" + ", ".join(map(str, CRC.tolist())) + "]::BIGINT[]"
    octets = "list_transform(range(0, len(hex(encode(named))) // 2), lambda i: CAST('0x' || substr(hex(encode(named)), 2 * i + 1, 2) AS BIGINT))"
    return rf"""
WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
own AS MATERIALIZED (SELECT run, CAST(doc_id AS VARCHAR) || ':' || run AS named, count(*) AS n FROM run WHERE length(run) >= {least} GROUP BY ALL),
sums AS MATERIALIZED (SELECT run, n, xor(list_reduce({octets}, lambda s, b: xor(s >> 8, ({table})[(xor(s, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM own),
word AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % {noise} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM sums)
  WHERE length(word) >= {least} GROUP BY word HAVING sum(n) >= {seen}),
place AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word),
cut AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM place),
blot AS MATERIALIZED (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS rest FROM place),
near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM blot a JOIN blot b ON a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT cut.word, word.word, word.n FROM cut JOIN word ON rest = word.word
  UNION ALL SELECT word.word, cut.word, cut.n FROM cut JOIN word ON rest = word.word),
best AS (SELECT word, count(*) AS n_near, min({{'m': -m, 'near': near}}) AS best FROM near GROUP BY word),
form AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= {ratio} * n THEN best.near END AS form, CASE WHEN -best.m >= {ratio} * n THEN -best.m END AS form_n
  FROM word LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON walk.root = form.word WHERE form.form IS NOT NULL),
last AS (SELECT walk.word, root FROM walk JOIN form ON walk.root = form.word WHERE form.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN last USING (word)"""


ORACLE_SQL: dict[str, str] = {
    "op2_no_random_access": TOP_K,
    "op4_license_windows": licenses(),
    "op5_super_minhash": near_duplicates(4, 80),
    "op7_super_kmers": substrings(),
    "op11_inverted_treaps": lexical(),
    "op12_neighbourhoods": spelling(),
    "op13_prefix_decontamination": decontamination(),
}
