"""DuckDB SQL of the engine's parts, as chains of common table expressions that the catalog's checking queries build on.

Cuts, features and matches are computed here anew from the documents' bytes; nothing is shared with the engine but fixed
values (the transforms' constants, masks, sizes).
"""

from __future__ import annotations

from chunkloom.functions import features as ft
from chunkloom.operators.segment import SMALL_FASTCDC, SMALL_GEARCDC, Cdc



def files(table: str = "documents", version: str = "source", file_id: str = "doc_id", text: str = "text") -> str:
    """v: versions in natural order; f: files."""
    return f"""v AS (SELECT path, row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all(upper(path), '([0-9]+|[^0-9]+)'),
  lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), ''), path) - 1 AS version_no FROM (SELECT DISTINCT {version} AS path FROM {table})),
f AS (SELECT version_no, {file_id} AS file_id, path, encode(coalesce({text}, '')) AS b FROM {table} JOIN v ON v.path = {version})"""


FILES = files()


def fixed(size: int, source: str = FILES) -> str:
    """k: chunks of `size` bytes."""
    return f"""{source},
k AS (SELECT version_no, file_id, off // {size} AS seq, off, b[off + 1:off + {size}] AS payload, octet_length(b[off + 1:off + {size}]) AS chunk_size, sha256(b[off + 1:off + {size}]) AS fp
  FROM (SELECT *, unnest(range(0, octet_length(b), {size})) AS off FROM f))"""


def content_defined(rule: Cdc, step: int = 256) -> str:
    """cuts (version_no, file_id, seq, begin, cut) and k: the rolling hash runs byte by byte in a fold over parts of up to
    `step` bytes; a recursion goes from part to part and from cut to cut, for all files side by side."""
    low = (1 << 33) - 1  # the fold's state: bytes done above, the hash below; a cut after n bytes is -n
    rolled = f"((x & {low}) >> 1) + y"
    return f"""{FILES},
gear AS (SELECT list(CAST(('0x' || substr(md5('gear32-' || i), 1, 8)) AS BIGINT) & 2147483647 ORDER BY i) AS t FROM range(256) r(i)),
w AS (SELECT version_no, file_id, off // {step} AS blk, octet_length(b) AS n, hex(b[off + 1:off + {step}]) AS x FROM (SELECT *, unnest(range(0, octet_length(b), {step})) AS off FROM f)),
wg AS (SELECT version_no, file_id, blk, n, list_transform(range(1, length(x), 2), lambda i: t[CAST(('0x' || substr(x, i, 2)) AS INT) + 1]) AS g FROM w, gear),
c AS (SELECT version_no, file_id, CAST(n AS BIGINT) AS n, CAST(0 AS BIGINT) AS start, CAST(least({rule.least}, n - 1) AS BIGINT) AS p, CAST(0 AS BIGINT) AS fp, CAST(NULL AS BIGINT) AS cut FROM wg WHERE blk = 0
  UNION ALL
  SELECT version_no, file_id, n, CASE WHEN done THEN stop ELSE start END, CASE WHEN done THEN least(stop + {rule.least}, n - 1) ELSE stop END, CASE WHEN done THEN 0 ELSE r & {low} END, CASE WHEN done THEN stop END
  FROM (SELECT *, CASE WHEN r < 0 THEN p - r ELSE until END AS stop, r < 0 OR until = least(n, start + {rule.most}) AS done
    FROM (SELECT *, list_reduce(list_prepend(CASE WHEN start + {rule.least} > p THEN 0 ELSE fp END, CASE WHEN start + {rule.least} >= n THEN [] ELSE g[p - blk * {step} + 1:until - blk * {step}] END),
        lambda x, y: CASE WHEN x < 0 THEN x WHEN ({rolled}) & {rule.mask} = 0 THEN -((x >> 33) + 1) ELSE (((x >> 33) + 1) << 33) + {rolled} END) AS r
      FROM (SELECT c.version_no, c.file_id, c.n, c.start, c.p, c.fp, blk, g, CASE WHEN c.start + {rule.least} >= c.n THEN c.n ELSE least(c.n, c.start + {rule.most}, (blk + 1) * {step}) END AS until
        FROM c JOIN wg ON wg.file_id = c.file_id AND wg.version_no = c.version_no AND wg.blk = c.p // {step} WHERE c.start < c.n)))),
cuts AS (SELECT version_no, file_id, cut, coalesce(lag(cut) OVER (PARTITION BY version_no, file_id ORDER BY cut), 0) AS begin, row_number() OVER (PARTITION BY version_no, file_id ORDER BY cut) - 1 AS seq FROM c WHERE cut IS NOT NULL),
k AS (SELECT cuts.version_no, cuts.file_id, seq, begin AS off, b[begin + 1:cut] AS payload, cut - begin AS chunk_size, sha256(b[begin + 1:cut]) AS fp FROM cuts JOIN f USING (version_no, file_id))"""


def unique(chunks: str) -> str:
    """o: chunks numbered within their fingerprint; u: unique chunks with chunk_id."""
    return f"""{chunks},
o AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY version_no, file_id, seq) AS nth, count(*) OVER (PARTITION BY fp) AS copies FROM k),
u AS (SELECT *, row_number() OVER (ORDER BY version_no, file_id, seq) - 1 AS chunk_id FROM o WHERE nth = 1)"""


#: Pages: the host is the version; a page's name is its address behind the host, without the last part.
HOST, PAGE_NAME = "split_part(url, '/', 3)", "regexp_replace(regexp_replace(url, '^[^:]*://[^/]*/', ''), '/?[^/]*$', '')"
PAGES = files("pages", HOST, "page_id", "html")
SMALL, SMALL_GEAR = unique(content_defined(SMALL_FASTCDC)), content_defined(SMALL_GEARCDC)
_TOP, _BODY = 1 << 63, (1 << 63) - 1
_NAMES = [f"f{j}" for j in range(ft.FEATURES)]


def _shifted(source: str, out: str, k: int) -> str:
    """Doubles the window of the gear hash: l[i] + (l[i - k] << k), modulo 2^64 in 64 bits."""
    a, b = "l[i]", f"((l[i - {k}] & {(1 << (64 - k)) - 1}::UBIGINT) << {k})"
    return f"{out} AS (SELECT chunk_id, list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i <= {k} THEN l[i] ELSE xor(({a} & {_BODY}::UBIGINT) + ({b} & {_BODY}::UBIGINT), xor({a}, {b}) & {_TOP}::UBIGINT) END) AS l FROM {source})"


def _signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= {_TOP}::UHUGEINT THEN {x}::HUGEINT - {1 << 64}::HUGEINT ELSE {x}::HUGEINT END AS BIGINT)"


def odess(chunks: str) -> str:
    """fe (chunk_id, version_no, chunk_size, sampled, f0 .. f11) of unique chunks u."""
    best = ", ".join(f"max((h * {a}::UHUGEINT + {b}::UHUGEINT) % {1 << 64}::UHUGEINT) AS m{j}" for j, (a, b) in enumerate(zip(ft.TRANSFORM_A, ft.TRANSFORM_B, strict=True)))
    return f"""{chunks},
g64 AS (SELECT list(CAST(('0x' || substr(md5('gear64-' || i), 1, 16)) AS UBIGINT) ORDER BY i) AS t64 FROM range(256) r(i)),
h1 AS (SELECT chunk_id, list_transform(range(1, length(x), 2), lambda i: t64[CAST(('0x' || substr(x, i, 2)) AS INT) + 1]) AS l FROM (SELECT chunk_id, hex(payload) AS x FROM u), g64),
{', '.join(_shifted(f'h{j + 1}', f'h{j + 2}', 1 << j) for j in range(6))},
hit AS (SELECT chunk_id, h::UHUGEINT AS h FROM (SELECT chunk_id, unnest(list_filter(l, lambda x: x & {ft.SAMPLE_MASK}::UBIGINT = 0)) AS h FROM h7)),
fe AS (SELECT u.chunk_id, u.version_no, u.chunk_size, coalesce(sampled, 0) AS sampled, {', '.join(f'coalesce({_signed(f"m{j}")}, 0) AS f{j}' for j in range(ft.FEATURES))}
  FROM u LEFT JOIN (SELECT chunk_id, count(*) AS sampled, {best} FROM hit GROUP BY chunk_id) USING (chunk_id))"""


def _joined(names: list[str]) -> str:
    return " || ',' || ".join(f"CAST({n} AS VARCHAR)" for n in names)


FEATURES = _joined(_NAMES)


def super_features(chunks: str, gate: int = ft.MIN_SIZE) -> str:
    """s (chunk_id, version_no, pos, sf): groups of four features of chunks larger than the gate."""
    each = " UNION ALL ".join(f"SELECT chunk_id, version_no, {i} AS pos, {_joined(_NAMES[4 * i : 4 * i + 4])} AS sf FROM fe WHERE chunk_size > {gate}" for i in range(3))
    return f"{odess(chunks)}, s AS ({each})"


def tiered(chunks: str) -> str:
    """t (chunk_id, version_no, tier, pos, sf): groups of four, three and two features."""
    each = " UNION ALL ".join(f"SELECT chunk_id, version_no, {tier} AS tier, {i} AS pos, {_joined(_NAMES[size * i : size * i + size])} AS sf FROM fe" for tier, size in ((1, 4), (2, 3), (3, 2)) for i in range(ft.FEATURES // size))
    return f"{odess(chunks)}, t AS ({each})"


def finesse(chunks: str) -> str:
    """fe (chunk_id, f0 .. f11): each twelfth's largest polynomial window hash; s (chunk_id, pos, sf): by rank."""
    p, base, win = ft.FINESSE_MOD, ft.FINESSE_BASE, ft.FINESSE_WINDOW
    double = lambda a, out, k: f"{out} AS (SELECT *, list_transform(range(1, len({a}) - {k} + 1), lambda i: ({a}[i] * {pow(base, k, p)} + {a}[i + {k}]) % {p}) AS {out}_ FROM {a[:-1]})"
    steps = ", ".join(double(f"q{k}_", f"q{2 * k}", k) for k in (1, 2, 4, 8, 16))
    cut = [f"n * {i} // {ft.FEATURES}" for i in range(ft.FEATURES + 1)]
    part = [f"CASE WHEN {cut[i + 1]} - {cut[i]} >= {win} THEN list_max(l[{cut[i]} + 1:{cut[i + 1]} - {win - 1}]) ELSE 0 END AS f{i}" for i in range(ft.FEATURES)]
    ranked = [" || ',' || ".join(f"CAST(list_sort([f{3 * g}, f{3 * g + 1}, f{3 * g + 2}])[{i + 1}] AS VARCHAR)" for g in range(4)) for i in range(3)]
    return f"""{chunks},
q1 AS (SELECT chunk_id, chunk_size AS n, list_transform(range(1, length(x), 2), lambda i: CAST(('0x' || substr(x, i, 2)) AS BIGINT)) AS q1_ FROM (SELECT chunk_id, chunk_size, hex(payload) AS x FROM u)),
{steps},
qw AS (SELECT chunk_id, n, list_transform(range(1, len(q1_) - {win} + 2), lambda i: (q32_[i] * {pow(base, win - 32, p)} + q16_[i + 32]) % {p}) AS l FROM q32),
fe AS (SELECT chunk_id, {', '.join(part)} FROM qw),
s AS ({' UNION ALL '.join(f'SELECT chunk_id, {i} AS pos, {r} AS sf FROM fe' for i, r in enumerate(ranked))})"""


def ntransform(chunks: str) -> str:
    """fe (chunk_id, f0 .. f11): for each transform the low 32 bits of the window hash where it is largest. Only those
    bits enter, so all is done modulo 2^32."""
    low, win = (1 << 32) - 1, ft.POLY_WINDOW
    double = lambda a, out, k: f"{out} AS (SELECT chunk_id, list_transform(range(1, len(l) - {k} + 1), lambda i: (l[i] * {pow(ft.POLY_BASE, k, 1 << 32)}::UBIGINT + l[i + {k}]) & {low}::UBIGINT) AS l FROM {a})"
    steps = ", ".join(double(f"n{k}", f"n{2 * k}", k) for k in (1, 2, 4, 8, 16, 32))
    value = [f"list_transform(l, lambda x: (x * {a & low}::UBIGINT + {b & low}::UBIGINT) & {low}::UBIGINT)" for a, b in zip(ft.TRANSFORM_A, ft.TRANSFORM_B, strict=True)]
    best = [f"coalesce(CASE WHEN list_max(v{j}) > 0 THEN l[list_position(v{j}, list_max(v{j}))] END, 0) AS f{j}" for j in range(ft.FEATURES)]
    return f"""{chunks},
n1 AS (SELECT chunk_id, list_transform(range(1, length(x), 2), lambda i: CAST(('0x' || substr(x, i, 2)) AS UBIGINT)) AS l FROM (SELECT chunk_id, hex(payload) AS x FROM u)),
{steps},
nw AS (SELECT chunk_id, l[1:len(l) - 1] AS l FROM n{win}),
fe AS (SELECT chunk_id, {', '.join(best)} FROM (SELECT chunk_id, l, {', '.join(f'{v} AS v{j}' for j, v in enumerate(value))} FROM nw))"""


#: Size of a delta in the block codec: 4 bytes, 4 for each block of 16 bytes that the base has at a block's place, and 1
#: more than their length for the others.
def block_delta(target: str, base: str) -> str:
    pieces = lambda x: f"list_transform(range(0, octet_length({x}), 16), lambda i: {x}[i + 1:i + 16])"
    return f"4 + list_sum(list_transform({pieces(target)}, lambda z: CASE WHEN list_contains({pieces(base)}, z) THEN 4 ELSE 1 + octet_length(z) END))"


FRAME = "OVER (PARTITION BY sf ORDER BY chunk_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
LATEST = f"""h AS (SELECT chunk_id, pos, max(chunk_id) {FRAME} AS base_id FROM s),
m AS (SELECT chunk_id, arg_min(base_id, pos) AS base_id FROM h WHERE base_id IS NOT NULL GROUP BY chunk_id)"""

#: d (chunk_id, version_no, chunk_size, is_header, base_id, kind, save_size): the latest match by features, taken if its
#: delta in the block codec is no larger than the chunk.
DECISIONS = f"""{super_features(SMALL)}, {LATEST},
sized AS (SELECT u.chunk_id, u.version_no, u.chunk_size, u.seq = 0 AS is_header, m.base_id, {block_delta('u.payload', 'x.payload')} AS delta FROM u LEFT JOIN m USING (chunk_id) LEFT JOIN u x ON x.chunk_id = m.base_id),
d AS (SELECT chunk_id, version_no, chunk_size, is_header, CASE WHEN ok THEN base_id END AS base_id, CASE WHEN ok THEN 'DELTA' ELSE 'BASE_RAW' END AS kind, CASE WHEN ok THEN delta ELSE chunk_size END AS save_size
  FROM (SELECT *, base_id IS NOT NULL AND delta <= chunk_size AS ok FROM sized))"""
