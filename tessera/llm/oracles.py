"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

from tessera.llm import xxh
from tessera.llm.decontaminate import GUARANTEE
from tessera.llm.infill import MIDDLE, PREFIX, SUFFIX, UNIT
from tessera.llm.pii import BASE, KEEP, KINDS, NEAR
from tessera.llm.secrets import BASE_RULES, MORE_RULES
from tessera.llm.sharding import DIMENSIONS, HEAVY
from tessera.llm.substrings import LENGTH

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def removal(length: int = LENGTH) -> str:
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - {length - 1})) AS i, unnest(list_transform(range(n - {length - 1}), lambda i: md5(substr(x, 2 * i + 1, {2 * length})))) AS h FROM d WHERE n >= {length}),
p AS (SELECT doc_id, unnest(range(n)) AS i, unnest(list_transform(range(n), lambda i: substr(x, 2 * i + 1, 2))) AS byte FROM d),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS k FROM w) WHERE k > 1),
b AS (SELECT p.doc_id, p.i, byte, max(CASE WHEN r.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM b),
s AS (SELECT doc_id, sum(gone) AS n_removed, sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS n_spans, string_agg(CASE WHEN gone = 0 THEN byte END, '' ORDER BY i) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CASE WHEN coalesce(kept, '') = '' THEN '{EMPTY}' ELSE sha256(unhex(kept)) END AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""


def archive() -> str:
    digit = lambda h, i: f"(strpos('0123456789abcdef', substr({h}, {i}, 1)) - 1)"
    groups = []
    for g in range(8):
        value = " + ".join(f"{16 ** (4 - k)} * {digit('h', 5 * g + k + 1)}" for k in range(5))
        groups += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({value}) // {32 ** (3 - k)}) % 32 AS BIGINT) + 1, 1)" for k in range(4)]
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {" || ".join(groups)} AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM p"""


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def contamination() -> str:
    words = lambda table, key: f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
    return f"""WITH b AS ({words("benchmark", "item_id")}), d AS ({words("documents", "doc_id")}),
bi AS (SELECT item_id, w, len(w) AS n, unnest(range(1, greatest(len(w) - {GUARANTEE - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(n, {GUARANTEE}) AS m, array_to_string(list_slice(w, i, i + least(n, {GUARANTEE}) - 1), ' ') AS s FROM bi),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s FROM di),
hit AS (SELECT doc_id, m, i, item_id FROM dw JOIN bw USING (m, s)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, '{EMPTY}') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


def either_case(pattern: str) -> str:
    """Letters outside classes and escapes as two-letter classes; folding beyond ASCII is not wanted."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            step = 4 if pattern[i + 1] == "x" else 2
            out.append(pattern[i : i + step])
            i += step
            continue
        inside = c == "[" or inside and c != "]"
        out.append(f"[{c}{c.upper()}]" if c.isalpha() and not inside else c)
        i += 1
    return "".join(out)


def secrets() -> str:
    """Matches and the gaps between them give every match its place."""
    least = {"assign": ("2", 6), "access": ("0", 20), "hex": ("0", 24)}
    parts = []
    for k, r in enumerate(BASE_RULES + MORE_RULES):
        # a run of a fixed class is a match of its least length or more: the same spans, and far fewer to place
        pattern = {"assign": either_case(r.pattern), "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}.get(r.kind, r.pattern).replace("'", "''")
        group, size = least.get(r.kind, ("0", 1))
        parts.append(
            f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, i, start, start + length(m[i]) AS stop FROM (SELECT doc_id, m, g, i, list_sum(list_transform(list_slice(gap, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS start FROM ("
            f"SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, string_split_regex(t, '{pattern}') AS gap, unnest(range(1, len(regexp_extract_all(t, '{pattern}', 0)) + 1)) AS i FROM d)) WHERE length(g[i]) >= {size}"
        )
    shown = "kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR)"
    counts = ", ".join(f"CAST(coalesce(sum(CASE WHEN kind = '{r.kind}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(CASE WHEN rank < {len(BASE_RULES)} THEN {shown} END, ',' ORDER BY start, rank), '')) AS base_sha256, coalesce(string_agg({shown}, ',' ORDER BY start, rank), '') AS spans FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


def placed(source: str, pattern: str, columns: str, where: str) -> str:
    """``columns`` of each match s of a pattern in t, from start to stop, that ``where`` accepts; gaps between give the places."""
    pattern = pattern.replace("'", "''")
    return (
        f"SELECT {columns} FROM (SELECT *, start + length(s) AS stop FROM (SELECT doc_id, t, m[i] AS s, list_sum(list_transform(list_slice(gap, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS start"
        f" FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS gap, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM {source}))) WHERE {where}"
    )


DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(string_split(reverse({DIGITS}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INTEGER) WHEN CAST(x AS INTEGER) > 4 THEN 2 * CAST(x AS INTEGER) - 9 ELSE 2 * CAST(x AS INTEGER) END)) % 10 = 0"
BARE = "replace(s, ' ', '')"
NUMBER = f"array_to_string(list_transform(string_split(substr({BARE}, 5) || left({BARE}, 4), ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
MOD97 = f"list_reduce(list_transform(string_split({NUMBER}, ''), lambda c: CAST(c AS BIGINT)), lambda a, b: (a * 10 + b) % 97) = 1"
CONFIRMED = {
    "email": "true",
    "ip": "len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || left(ltrim(x, '0'), 3) AS INTEGER) > 255)) = 0",
    "card": f"length({DIGITS}) BETWEEN 12 AND 19 AND {LUHN}",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
    "iban": MOD97,
    "ssn": "regexp_full_match(s, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND left(s, 3) NOT IN ('000', '666') AND left(s, 1) <> '9' AND substr(s, 5, 2) <> '00' AND right(s, 4) <> '0000'",
}


def personal() -> str:
    parts = []
    near = f"(substr(t, CAST(greatest(start - {NEAR}, 0) + 1 AS BIGINT), CAST(least(start, {NEAR}) AS BIGINT)) || ' ' || chr(10) || ' ' || substr(t, CAST(stop + 1 AS BIGINT), {NEAR}))"
    for k, kind in enumerate(KINDS):
        pattern = {"ssn": "[0-9-]+"}.get(kind.name, kind.pattern.pattern.removeprefix("(?<![0-9])").removeprefix("(?a)"))
        moves = lambda words, by: f" {by} CASE WHEN regexp_matches({near}, '{either_case(words.pattern.removeprefix('(?ai)'))}') THEN 3 ELSE 0 END" if words else ""
        score = f"least(10, greatest(0, {round(10 * kind.start)}{moves(kind.context, '+')}{moves(kind.against, '-')}))"
        parts.append(f"SELECT * FROM ({placed('d', pattern, f'doc_id, {k} AS rank, {chr(39)}{kind.name}{chr(39)} AS kind, start, stop, {score} AS score', CONFIRMED[kind.name])})" + ("" if kind.base else f" WHERE score >= {round(10 * KEEP)}"))
    shown = "kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR)"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(CASE WHEN rank < {len(BASE)} THEN {shown} END, ',' ORDER BY start, rank), '')) AS base_sha256, coalesce(string_agg({shown}, ',' ORDER BY start, rank), '') AS spans, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY start, rank), '') AS scores FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


WORDS = "[^\\x20\\x09-\\x0D]+"


def statistics(window: int = 5) -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {window - 1}), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {window})) AS p FROM r) GROUP BY 1),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o"""


def shards(count: int = 8) -> str:
    """Three levels of the tree, each a few tables; the digests are those of CRC-32, from its table."""
    levels = count.bit_length() - 1
    d = DIMENSIONS
    ctes = {
        "crc": "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS tab",
        "raw": "SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) + 1 AS size, dense_rank() OVER (ORDER BY coalesce(source, '')) - 1 AS d_source, dense_rank() OVER (ORDER BY coalesce(lang, '')) - 1 AS d_lang FROM documents",
        "rows_": "SELECT doc_id, size, md5(t) AS g, d_source, d_lang, xor(list_reduce(list_prepend(4294967295, list_transform(range(size - 1), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])), 4294967295) AS crc FROM raw, crc",
        "p0": "SELECT g, CAST(sum(size) AS BIGINT) AS high, CAST(0 AS BIGINT) AS low, max(size) AS unit, CAST(max(size) AS DOUBLE) AS d_size, CAST(min(d_source) AS DOUBLE) AS d_source, CAST(min(d_lang) AS DOUBLE) AS d_lang, CAST(coalesce(min(doc_id), 0) AS DOUBLE) AS d_id, 1 AS path FROM rows_ GROUP BY g",
        "root": "SELECT " + ", ".join(f"coalesce(nullif(max({x}) - min({x}), 0), 1.0) AS {x}" for x in d) + " FROM p0",
        "goal": f"SELECT CAST(ceil(sum(size) / {count}) AS BIGINT) AS bytes FROM rows_",
    }
    for k in range(levels):
        widths = ", ".join(f"(max(p.{x}) - min(p.{x})) / any_value(root.{x}) AS w{i}" for i, x in enumerate(d))
        most = "greatest(" + ", ".join(f"w{i}" for i in range(len(d))) + ")"
        key = "CASE dimension " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(d)) + " END"
        ctes |= {
            f"s{k}": f"SELECT path, CAST(sum(high - low) AS BIGINT) AS whole, max(high - low - unit) AS spare, count(*) AS n, {widths} FROM p{k} p, root GROUP BY path",
            f"n{k}": f"SELECT path, whole, CASE {' '.join(f'WHEN w{i} = {most} THEN {i}' for i in range(len(d)))} END AS dimension FROM s{k}, goal WHERE whole > goal.bytes AND (n > 1 OR spare > 0)",
            f"o{k}": f"SELECT *, whole // 2 - CAST(coalesce(sum(high - low) OVER (PARTITION BY path ORDER BY key, g, low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS over_ FROM (SELECT *, {key} AS key FROM p{k} JOIN n{k} USING (path))",
            f"c{k}": f"SELECT *, over_ > 0 AND over_ < high - low AND high - low > {HEAVY} * whole AS cut FROM o{k}",
            f"p{k + 1}": f"SELECT g, low + over_ AS high, low, unit, {', '.join(d)}, 2 * path AS path FROM c{k} WHERE cut UNION ALL SELECT g, high, low + over_, unit, {', '.join(d)}, 2 * path + 1 FROM c{k} WHERE cut"
            f" UNION ALL SELECT g, high, low, unit, {', '.join(d)}, CASE WHEN 2 * over_ >= high - low THEN 2 * path ELSE 2 * path + 1 END FROM c{k} WHERE NOT cut UNION ALL SELECT g, high, low, unit, {', '.join(d)}, path FROM p{k} WHERE path NOT IN (SELECT path FROM n{k})",
        }
    last = f"p{levels}"
    ctes |= {
        "spots": "SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, crc, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + size // 2 AS middle FROM rows_",
        "done": f"SELECT doc_id, size, crc, path * CAST(2 ** ({levels} - floor(log2(path))) AS BIGINT) - {count} AS shard FROM spots JOIN {last} USING (g) WHERE middle >= low AND middle < high",
    }
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM done"


def fingerprints(shingle: int = 3) -> str:
    """XXH64 in unsigned 128-bit numbers, on the little-endian lanes of each different shingle."""
    p1, p2, p3, p4, p5 = (int(x) for x in (xxh.P1, xxh.P2, xxh.P3, xxh.P4, xxh.P5))
    size = 1 << 64
    times = lambda a, b: f"CAST((CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT)) % {size}::UHUGEINT AS UBIGINT)"
    plus = lambda a, b: f"CAST((CAST({a} AS UHUGEINT) + CAST({b} AS UHUGEINT)) % {size}::UHUGEINT AS UBIGINT)"
    turn = lambda a, n: f"CAST((CAST({a} AS UHUGEINT) * {1 << n}::UHUGEINT) % {size}::UHUGEINT + CAST({a} AS UHUGEINT) // {1 << 64 - n}::UHUGEINT AS UBIGINT)"
    little = lambda at, n: "CAST('0x' || " + " || ".join(f"substr(x, CAST({at} AS BIGINT) + {2 * k + 1}, 2)" for k in reversed(range(n))) + " AS UBIGINT)"
    # a value that is used twice is named by a one-element list
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    lane = lambda acc, v: let(plus(acc, times(v, p2)), "y", times(turn("y", 31), p1))
    steps = lambda first, values, name, body: f"list_reduce(list_prepend(CAST({first} AS UBIGINT), {values}), lambda h, {name}: {body})"
    ctes = {
        "d": f"SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORDS}') AS w FROM documents",
        "i": f"SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0",
        "s": f"SELECT doc_id, array_to_string(list_slice(w, i, i + {shingle - 1}), ' ') AS s FROM i",
        "u": "SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM s)",
        "v": f"SELECT *, list_transform(range(n // 8), lambda k: {little('16 * k', 8)}) AS lanes FROM u",
    }
    accs = [(42 + p1 + p2) % size, (42 + p2) % size, 42, (42 - p1) % size]
    for j, first in enumerate(accs):
        values = f"list_transform(range(n // 32), lambda k: lanes[4 * k + {j + 1}])"
        ctes[f"a{j}"] = f"SELECT *, {steps(first, values, 'v', lane('h', 'v'))} AS a{j} FROM {f'a{j - 1}' if j else 'v'}"
    ctes["m0"] = "SELECT *, " + plus(plus(plus(turn("a0", 1), turn("a1", 7)), turn("a2", 12)), turn("a3", 18)) + " AS m FROM a3"
    for j in range(4):
        mixed = let(f"xor(m, {lane('0', f'a{j}')})", "z", plus(times("z", p1), p4))
        ctes[f"m{j + 1}"] = f"SELECT * EXCLUDE (m), {mixed} AS m FROM m{j}"
    ctes["b0"] = f"SELECT s, x, n, lanes, {plus(f'CASE WHEN n >= 32 THEN m ELSE CAST({(42 + p5) % size} AS UBIGINT) END', 'n')} AS h FROM m4"
    word = let(f"xor(h, {lane('0', 'v')})", "z", plus(times(turn("z", 27), p1), p4))
    ctes["b1"] = f"SELECT * EXCLUDE (h), {steps('h', 'list_slice(lanes, 4 * (n // 32) + 1, n // 8)', 'v', word)} AS h FROM b0"
    half = let(f"xor(h, {times(little('16 * (n // 8)', 4), p1)})", "z", plus(times(turn("z", 23), p2), p3))
    ctes["b2"] = f"SELECT * EXCLUDE (h), CASE WHEN n % 8 >= 4 THEN {half} ELSE h END AS h FROM b1"
    tail = f"list_transform(range(n - n % 4, n), lambda k: {little('2 * k', 1)})"
    ctes["b3"] = f"SELECT * EXCLUDE (h), {steps('h', tail, 'v', let(f'xor(h, {times(chr(118), p5)})', 'z', times(turn('z', 11), p1)))} AS h FROM b2"
    for k, (shift, by) in enumerate([(33, p2), (29, p3), (32, 1)]):
        ctes[f"b{k + 4}"] = f"SELECT * EXCLUDE (h), {times(f'xor(h, h >> {shift})', by)} AS h FROM b{k + 3}"
    bits = " + ".join(f"CASE WHEN 2 * sum(CAST((h >> {b}) & 1 AS INTEGER)) > count(*) THEN CAST({1 << b} AS UHUGEINT) ELSE 0 END" for b in range(64))
    ctes |= {
        "f": f"SELECT doc_id, CAST({bits} AS UBIGINT) AS fp FROM s JOIN b6 USING (s) GROUP BY doc_id",
        "p": "SELECT d.doc_id, coalesce(fp, 0) AS fp FROM d LEFT JOIN f USING (doc_id)",
        "c": "SELECT fp, min(doc_id) AS first FROM p GROUP BY fp",
        "l": "SELECT a.fp AS a, b.fp AS b FROM c a JOIN c b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS HUGEINT)) <= 3",
        "reach": "SELECT fp AS a, fp AS b FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a",
        "least": "SELECT a AS fp, min(first) AS component_id FROM reach JOIN c ON c.fp = reach.b GROUP BY 1",
    }
    hexed = " || ".join(f"substr('0123456789abcdef', CAST((fp >> {4 * k}) & 15 AS BIGINT) + 1, 1)" for k in reversed(range(16)))
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + f" SELECT doc_id, {hexed} AS fingerprint, component_id FROM p JOIN least USING (fp)"


def similar(shingle: int = 5, percent: int = 85) -> str:
    """Whole sets of all pairs with a common shingle, and what is reachable over links."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORDS}') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {shingle - 1}), ' ') AS s FROM i),
z AS (SELECT doc_id, list_sort(list(s)) AS l, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT l, min(doc_id) AS node, any_value(n) AS n FROM z GROUP BY l),
e AS (SELECT node, n, unnest(l) AS s FROM c),
p AS (SELECT a.node AS a, b.node AS b, a.n + b.n AS n, count(*) AS k FROM e a JOIN e b ON a.s = b.s AND a.node <> b.node GROUP BY 1, 2, 3),
l AS (SELECT a, b FROM p WHERE 100 * k >= {percent} * (n - k)),
reach AS (SELECT node AS a, node AS b FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
least AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY 1),
o AS (SELECT z.doc_id, z.n, component_id FROM z JOIN c USING (l) JOIN least USING (node))
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept FROM d LEFT JOIN o USING (doc_id)"""


def arrangements() -> str:
    h = lambda i: f"CAST('0x' || substr(k, {8 * i + 1}, 8) AS BIGINT)"
    part = lambda a, b: f"array_to_string(list_slice(u, CAST({a} AS BIGINT), CAST({b} AS BIGINT)), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u, sha256('1:' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {h(0)} % (len(u) + 1) AS x, {h(1)} % (len(u) + 1) AS y, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {h(2)} % 100 >= 90 THEN 'plain' WHEN {h(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, {part(1, "least(x, y)")} AS a, {part("least(x, y) + 1", "greatest(x, y)")} AS m, {part("greatest(x, y) + 1", "n")} AS s FROM c),
o AS (SELECT *, CASE form WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || s || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || a || '{MIDDLE}' || m ELSE t END AS o FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars, sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""


CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS tab"


def prefix_trie() -> str:
    """Nodes are lists of (role, text); CRC-32 from its table."""
    return f"""WITH crc AS ({CRC_TABLE}),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(CAST(octet_length(encode(r)) AS VARCHAR) || ':' || r || x)) AS l FROM t GROUP BY conv_id),
h AS (SELECT conv_id AS c, l, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(CAST(conv_id AS VARCHAR)))), lambda i: CAST('0x' || substr(hex(encode(CAST(conv_id AS VARCHAR))), 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1])), 4294967295) % 9 AS h FROM o, crc),
b AS (SELECT c, list_concat(list_slice(coalesce(o.l, []), 1, h), list_slice(h.l, h + 1, len(h.l))) AS l FROM h LEFT JOIN o ON o.conv_id = c - c % 5),
p AS (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM b),
n AS (SELECT d, list_slice(l, 1, d) AS k, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN octet_length(encode(l[d].x)) ELSE 0 END) AS bytes, sha256(coalesce(string_agg(CASE WHEN len(l) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
m AS (SELECT d - 1 AS d, list_slice(k, 1, d - 1) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM n LEFT JOIN m USING (d, k)),
s AS (SELECT a AS d, list_slice(k, 1, a) AS k, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM w) GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256 FROM w JOIN s USING (d, k) LEFT JOIN n u ON u.d = w.d - 1 AND u.k = list_slice(w.k, 1, w.d - 1)"""


ORACLES = {
    "op1_suffix_dedup": removal(),
    "op2_kd_tree_sharding": shards(),
    "op4_warc_index": archive(),
    "op5_secret_scan": secrets(),
    "op7_pii": personal(),
    "op9_benchmark_decontamination": contamination(),
    "op10_simhash_near_dedup": fingerprints(),
    "op11_minhash_near_dedup": similar(),
    "op12_fill_in_middle": arrangements(),
    "op13_conversation_trie": prefix_trie(),
    "quality_statistics": statistics(),
}
