"""The catalogue's queries in DuckDB's SQL, written from the same definitions and independently of the Spark plans."""

from __future__ import annotations

# Fixed values, written out here again so that a wrong one in the engine shows.
TAG = r"</?[A-Za-z][^>]*>"
RISKY_TAG = r"(?i)<(script|iframe|object|embed)\b"
CURRENCY = r"(?i)^\s*[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]{1,2})?(\s*(USD|EUR|GBP|dollars?|euros?|pounds?|million|billion|trillion))?\s*$"
STRONG_SYMBOLS = r"[_^={}≤≥∫∑√]"
OPERATION = r"[A-Za-z0-9)\]}]\s*[+\-*/=<>]\s*[A-Za-z0-9({\[]"
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"
MATH_COMMANDS = ("frac", "dfrac", "tfrac", "sqrt", "sum", "prod", "int", "iint", "iiint", "lim", "log", "ln", "sin", "cos", "tan", "alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "rho", "sigma", "omega",
                 "partial", "nabla", "cdot", "times", "leq", "geq", "neq", "approx", "infty", "mathrm", "mathbf", "mathit", "text", "begin", "end")
MATH_SUBJECTS = ("mathematics", "physics", "chemistry", "astronomy", "electricalengineering", "electrical engineering")
HEIGHTS = (64, 96, 128, 192, 256, 320, 384, 448, 512)

SP = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MARK = "chr(57344)"  # a private character that stands between sentences


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^[{SP}]+|[{SP}]+$", "")


def unix(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def normalize(x: str, collapse: bool = True, nfc: bool = False) -> str:
    x = sub(f"replace({unix(x)}, chr(9), '    ')", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    if nfc:
        x = f"nfc_normalize({x})"
    x = sub(x, r"[ \x{a0}]+\n", "\n")
    if collapse:
        x = sub(x, r"[ \t\x{a0}]+", " ")
    return strip(sub(x, r"\n{4,}", "\n\n\n"))


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def flags(x: str) -> str:
    math = f"({matches(x, r'\\\(.*?\\\)')} OR {matches(x, r'\\\[.*?\\\]')})"
    tabs = f"len(list_filter(string_split({x}, chr(10)), lambda l: contains(l, chr(9)) AND length(l) > 10)) >= 2"
    pipes = matches(x, r"(?m)^\|.+\|.+\|$")
    return f"((CASE WHEN {math} THEN 1 ELSE 0 END) + (CASE WHEN {tabs} OR {pipes} THEN 2 ELSE 0 END) + (CASE WHEN {matches(x, TAG)} THEN 4 ELSE 0 END))::INTEGER"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, {q(r'([.!?。！？；;])[' + SP + ']+')}, '\\1' || {MARK}, 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({marked}, {MARK} || '|\\n+'), lambda s: {strip('s')}), lambda s: s <> '')"


def paragraphs(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {q(chr(10) + '[' + SP + ']*' + chr(10))}), lambda p: {strip('p')}), lambda p: p <> '')"


CHUNKS = f"""
paras AS (SELECT doc_id, subject, unnest({paragraphs('t')}) AS x, generate_subscripts({paragraphs('t')}, 1) AS k
          FROM (SELECT doc_id, subject, {normalize('text', collapse=False)} AS t FROM documents WHERE text IS NOT NULL)),
folded AS (SELECT doc_id, subject, k, list_reduce(list_transform(CASE WHEN length(x) <= 420 THEN [x] ELSE {sentences('x')} END, lambda s: {{'s': s, 'done': []::VARCHAR[], 'opened': ''}}), lambda a, b: __STEP__, {{'s': '', 'done': []::VARCHAR[], 'opened': ''}}) AS f FROM paras),
parts AS (SELECT doc_id, subject, k, CASE WHEN f.opened = '' THEN f.done ELSE list_append(f.done, f.opened) END AS c FROM folded),
chunked AS (SELECT doc_id, any_value(subject) AS subject, flatten(list(c ORDER BY k)) AS chunks FROM parts GROUP BY doc_id)
"""


def _step(n: int = 420) -> str:
    flushed = "CASE WHEN a.opened = '' THEN a.done ELSE list_append(a.done, a.opened) END"
    joined = "CASE WHEN a.opened = '' THEN b.s ELSE a.opened || ' ' || b.s END"
    slices = f"list_transform(range(0, (length(b.s) - 1) // {n} + 1), lambda k: substr(b.s, (k * {n} + 1)::INTEGER, {n}))"
    return (
        f"CASE WHEN length(b.s) > {n} THEN {{'s': '', 'done': list_concat({flushed}, {slices}), 'opened': ''}}"
        f" WHEN length({joined}) <= {n} THEN {{'s': '', 'done': a.done, 'opened': {joined}}} ELSE {{'s': '', 'done': {flushed}, 'opened': b.s}} END"
    )


CHUNKS = CHUNKS.replace("__STEP__", _step())
CHUNKS_NFC = CHUNKS.replace(normalize("text", collapse=False), normalize("text", collapse=False, nfc=True))

PACK = """
folds AS (SELECT doc_id, subject, chunks, list_reduce(list_transform(chunks, lambda c: {'cost': greatest(1, length(c)), 'page': 0, 'used': 0, 'pages': []::INTEGER[]}),
          lambda a, b: {'cost': b.cost, 'page': a.page + (a.used > 0 AND a.used + b.cost > 950)::INTEGER,
                        'used': CASE WHEN a.used > 0 AND a.used + b.cost > 950 THEN b.cost ELSE a.used + b.cost END,
                        'pages': list_append(a.pages, a.page + (a.used > 0 AND a.used + b.cost > 950)::INTEGER)},
          {'cost': 0::BIGINT, 'page': 0, 'used': 0::BIGINT, 'pages': []::INTEGER[]}) AS f FROM chunked WHERE len(chunks) > 0),
packed AS (SELECT doc_id, subject, unnest(chunks) AS chunk, unnest(f.pages) AS page, generate_subscripts(chunks, 1) AS k FROM folds)
"""

TIDY = f"tidy AS (SELECT doc_id, source, subject, added_at, t AS text, sha1(t) AS sha1 FROM (SELECT *, {normalize('text')} AS t FROM documents) WHERE t <> '')"


def u60(key: str, seed: object) -> str:
    return f"('0x' || substr(sha256({key} || ':{seed}'), 1, 15))::BIGINT"


def split(key: str, val: float = 0.08, test: float = 0.08) -> str:
    whole = 1 << 60
    return f"CASE WHEN {u60(key, 42)} < {int(test * whole)} THEN 'test' WHEN {u60(key, 42)} < {int((test + val) * whole)} THEN 'val' ELSE 'train' END"


def boundaries(x: str) -> str:
    inner = f"list_filter(range(1, length({x}) + 1), lambda i: substr({x}, i, 1) = chr(10) OR (contains('.!?。！？', substr({x}, i, 1)) AND i < length({x}) AND substr({x}, i + 1, 1) IN (' ', chr(10))))"
    return f"list_sort(list_distinct(list_concat([0::BIGINT], {inner}, [length({x})::BIGINT])))"


BAD_JSON = "NOT json_valid(line)"
LINES = f"lines AS (SELECT * FROM raw_records WHERE {strip('line')} <> '')"


def _text_field(f: str) -> str:
    j = f"json_extract(j, '$.{f}')"
    listed = f"array_to_string(list_transform(json_extract({j}, '$[*]'), lambda e: coalesce(e ->> '$', 'None')), chr(10))"
    return f"nullif(CASE json_type({j}) WHEN 'VARCHAR' THEN {j} ->> '$' WHEN 'ARRAY' THEN {listed} END, '')"


def _label_field(f: str) -> str:
    j = f"json_extract(j, '$.{f}')"
    return f"nullif(CASE json_type({j}) WHEN 'VARCHAR' THEN {j} ->> '$' WHEN 'ARRAY' THEN json_extract({j}, '$[0]') ->> '$' END, '')"


_own = "json_extract(j, '$.id') ->> '$'"
_other = "json_extract(j, '$.doc_id') ->> '$'"
PICKED = f"""
{LINES},
good AS (SELECT source_file, line_no, line::JSON AS j FROM lines WHERE json_valid(line)),
picked AS (SELECT source_file, line_no, coalesce({', '.join(_text_field(f) for f in ('text', 'content', 'body', 'abstract'))}, '') AS text,
           coalesce({', '.join(_label_field(f) for f in ('subject', 'category', 'discipline', 'final_subjects'))}, '') AS subject,
           coalesce({_own}, {_other}, '') AS id0 FROM good)
"""

DISTINCT_PAGES = "(SELECT DISTINCT id FROM page_records)"

PART = "CASE p.kind WHEN 'text' THEN coalesce(p.text, '') WHEN 'math_inline' THEN coalesce(nullif(p.target, ''), '\\(' || coalesce(p.tex, '') || '\\)') ELSE '' END"


def block_target(b: str) -> str:
    cells = f"array_to_string(list_transform(coalesce({b}.rows, []), lambda r: array_to_string(r, chr(9))), chr(10))"
    return strip(
        f"(CASE {b}.kind WHEN 'paragraph' THEN array_to_string(list_transform(coalesce({b}.parts, []), lambda p: {PART}), '')"
        f" WHEN 'math_display' THEN coalesce(nullif({b}.target, ''), '\\[' || coalesce({b}.tex, '') || '\\]')"
        f" WHEN 'table' THEN coalesce(nullif({b}.target, ''), {cells}) ELSE '' END)"
    )


JOINED = strip(f"array_to_string(list_filter(list_transform(blocks, lambda b: {block_target('b')}), lambda t: t <> ''), chr(10))")
BLOCK_FLAGS = """((CASE WHEN len(list_filter(blocks, lambda b: b.kind = 'math_display' OR len(list_filter(coalesce(b.parts, []), lambda p: p.kind = 'math_inline')) > 0)) > 0 THEN 1 ELSE 0 END)
 + (CASE WHEN len(list_filter(blocks, lambda b: b.kind = 'table')) > 0 THEN 2 ELSE 0 END))::INTEGER"""


def esc(x: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{sign}', '{name}')"
    return x


def _span(kind: str, tex: str) -> str:
    t = esc(f"coalesce({tex}, '')")
    return f"'<span class=\"math-render math-{kind}\" data-tex=\"' || {t} || '\">' || {t} || '</span>'"


_row = f"'<tr>' || chr(10) || array_to_string(list_transform(r, lambda c: '<td>' || {esc("coalesce(c, '')")} || '</td>' || chr(10)), '') || '</tr>'"
MARKUP_LIST = f"""list_transform(blocks, lambda b: CASE WHEN b.kind = 'paragraph' THEN '<p>' || array_to_string(list_transform(coalesce(b.parts, []),
 lambda p: CASE WHEN p.kind = 'math_inline' THEN {_span('inline', 'p.tex')} ELSE {esc("coalesce(p.text, '')")} END), '') || '</p>'
 WHEN b.kind = 'math_display' THEN '<div class="math-display-wrapper">' || {_span('display', 'b.tex')} || '</div>'
 WHEN b.kind = 'table' AND len(coalesce(b.rows, [])) > 0 THEN '<table><tbody>' || chr(10) || array_to_string(list_transform(b.rows, lambda r: {_row}), chr(10)) || chr(10) || '</tbody></table>'
 ELSE '' END)"""
MARKUP = f"array_to_string({MARKUP_LIST}, chr(10))"

IDS = "list_transform(string_split({x}, ''), lambda c: (unicode(c) % 1000)::BIGINT)"


def ids(x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN {IDS.format(x=x)} ELSE []::BIGINT[] END"


_image = "list_concat([5::BIGINT], list_transform(range(64), lambda i: 7::BIGINT), [6::BIGINT])"
SEQUENCES = f"""
seqs AS (SELECT spec_id, task_type, CASE WHEN replay THEN []::BIGINT[] WHEN task_type IN ('optical_continuation', 'span_reconstruction') THEN list_concat({ids('prefix')}, {_image}) ELSE {_image} END AS ctx,
         list_concat({ids('answer')}, [1::BIGINT]) AS ans
         FROM (SELECT spec_id, task_type, coalesce(is_text_only, false) AS replay, coalesce(prefix_text, '') AS prefix, coalesce(target_text, '') AS answer FROM task_specs)),
rows_ AS (SELECT spec_id, task_type, list_concat(ctx, ans)[1:1024] AS ids, list_concat(list_transform(ctx, lambda x: -100::BIGINT), ans)[1:1024] AS labels, greatest(0, least(len(ctx) + len(ans), 1024) - len(ctx)) AS n_labels FROM seqs)
"""

CHARS = "chars AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0) WHERE ch <> '' GROUP BY ch)"
VOCAB = """vocab AS (SELECT ch AS token, (row_number() OVER (ORDER BY n DESC, ch) - 1)::INTEGER AS id FROM
 (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM area_examples WHERE length(text) > 0) WHERE ch <> '' GROUP BY ch))"""

MEASURED = """measured AS (SELECT *, least(chars * 9, 900)::INTEGER AS content_w, (ceil(chars * 9 / 900) * font)::INTEGER AS content_h
 FROM (SELECT doc_id, length(text) AS chars, (doc_id % 15 + 18)::INTEGER AS font FROM documents WHERE length(text) > 0))"""
CANVAS = """sized AS (SELECT doc_id, (ceil((content_w + 64) / 32) * 32)::INTEGER AS w0, (ceil((content_h + 48) / 32) * 32)::INTEGER AS h0 FROM measured),
canvas AS (SELECT doc_id, greatest(least(w0, 1024), 256) AS width, greatest(least(h0, 512), 64) AS height, w0 > 1024 OR h0 > 512 AS overflow FROM sized)"""
BUCKETS = "[" + ", ".join(map(str, HEIGHTS)) + "]"


def chat() -> str:
    asked = "trim(replace(replace(coalesce(m.content, ''), '<image>' || chr(10), ''), '<image>', ''))"
    said = "trim(coalesce(m.content, ''))"
    lit = lambda t: ids(q(t).replace("\n", "' || chr(10) || '"))
    hidden = lambda x: f"list_transform({x}, lambda i: -100::BIGINT)"
    end, user, answer, head = (lit(t) for t in ("<|im_end|>\n", "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n"))
    shown = f"list_concat({user}, CASE WHEN k = 1 AND nt > 0 THEN {_image} ELSE []::BIGINT[] END, {ids(asked)}, {end})"
    return f"""WITH turns AS (SELECT chat_id, CASE WHEN len(images) > 0 THEN 64 ELSE 0 END AS nt, messages FROM chat_rows),
    each AS (SELECT chat_id, nt, unnest(messages) AS m, generate_subscripts(messages, 1) AS k FROM turns),
    said AS (SELECT chat_id, k, CASE WHEN m.role = 'user' AND {asked} <> '' THEN {shown} WHEN m.role = 'assistant' AND {said} <> '' THEN list_concat({answer}, {ids(said)}, {end}) ELSE []::BIGINT[] END AS x,
                    CASE WHEN m.role = 'user' AND {asked} <> '' THEN {hidden(shown)} WHEN m.role = 'assistant' AND {said} <> '' THEN list_concat({hidden(answer)}, {ids(said)}, {hidden(end)}) ELSE []::BIGINT[] END AS y FROM each),
    joined AS (SELECT chat_id, flatten(list(x ORDER BY k)) AS x, flatten(list(y ORDER BY k)) AS y FROM said GROUP BY chat_id)
    SELECT t.chat_id, list_concat({head}, coalesce(x, []::BIGINT[]))[1:4096] AS ids, list_concat({hidden(head)}, coalesce(y, []::BIGINT[]))[1:4096] AS labels FROM turns t LEFT JOIN joined USING (chat_id)"""


_SIMPLE_SPLIT = split("doc_id::VARCHAR")
_price = CURRENCY.replace(r"(?i)^\s*", r"(?i)^\s*")
_command = r"\\(" + "|".join(MATH_COMMANDS) + r")\b"
_area = "(h * w)::DOUBLE"


def _snap(x: str, f: str) -> str:
    return f"greatest(32, ({f}({x} / 32.0::DOUBLE) * 32)::INTEGER)"


_down, _up = f"sqrt({_area} / 3200000.0::DOUBLE)", f"sqrt(50176.0::DOUBLE / {_area})"
_stray = r"[\x00-\x08\x0b-\x1f]"


def _n(s: str) -> str:
    return f"((length(t) - length(replace(t, '{s}', ''))) // {len(s)})"


_round = f"({_n(chr(92) + '(')} - {_n(chr(92) + '|')})"
ISSUES = f"""list_filter([CASE WHEN coalesce(id, '') = '' THEN 'missing id' END, CASE WHEN coalesce(t, '') = '' THEN 'empty target_text' END,
 CASE WHEN length(t) > 0 AND {matches('t', _stray)} THEN 'control_chars=' || (length(t) - length({sub('t', _stray, '')})) END,
 CASE WHEN length(t) > 0 AND {_round} <> {_n(chr(92) + ')')} THEN 'latex_paren_mismatch: ' || {_round} || ' vs ' || {_n(chr(92) + ')')} END,
 CASE WHEN length(t) > 0 AND {_n(chr(92) + '[')} <> {_n(chr(92) + ']')} THEN 'latex_bracket_mismatch: ' || {_n(chr(92) + '[')} || ' vs ' || {_n(chr(92) + ']')} END], lambda i: i IS NOT NULL)"""

SQL: dict[str, str] = {
    "nested_fields": f"""WITH {LINES}, good AS (SELECT source_file, line_no, line::JSON AS j FROM lines WHERE json_valid(line)),
        v AS (SELECT *, [json_extract(j, '$.document.text') ->> '$', json_extract(j, '$.text') ->> '$', json_extract(j, '$.content') ->> '$'] AS vs FROM good)
        SELECT source_file, line_no, list_filter(vs, lambda x: x IS NOT NULL AND {strip('x')} <> '')[1] AS value FROM v""",
    "manifest_scan": f"SELECT doc_id, sha256(doc_id || ':1:42') AS place FROM documents WHERE length(text) > 0 AND {u60('doc_id', 'shard')} % 4 = 1 ORDER BY place LIMIT 50",
    "contiguous_chunks": 'SELECT chunk::INTEGER AS chunk, count(*) AS n, min(doc_id) AS "first", max(doc_id) AS "last" FROM (SELECT doc_id, ntile(4) OVER (ORDER BY doc_id) AS chunk FROM documents) GROUP BY 1',
    "preview_sample": f"SELECT id FROM {DISTINCT_PAGES} WHERE {u60('id', 'preview')} < {int(0.1 * (1 << 60))}",
    "image_chat_rows": f"""SELECT 'images/' || {sub('id', r'[^\p{L}\p{N}\-_.]', '_')} || '.png' AS image, '<image>' || chr(10) || 'Read the text in the image.' AS prompt, target_text AS answer
        FROM (SELECT DISTINCT id, target_text FROM page_records WHERE target_text <> '')""",
    "raw_scan_skip": f"WITH {LINES} SELECT source_file, count(*) AS n FROM lines WHERE json_valid(line) GROUP BY source_file",
    "raw_scan_rejects": f"WITH {LINES} SELECT CASE WHEN {BAD_JSON} THEN 'malformed' ELSE 'ok' END AS reason, count(*) AS n FROM lines GROUP BY 1",
    "raw_scan_fail_file": f"""WITH {LINES}, bad AS (SELECT source_file, min(line_no) AS b FROM lines WHERE {BAD_JSON} GROUP BY 1)
        SELECT source_file, count(*) AS n, max(line_no) AS last_line FROM lines LEFT JOIN bad USING (source_file) WHERE b IS NULL OR line_no < b GROUP BY source_file""",
    "pick_fields": f"WITH {PICKED} SELECT source_file, line_no, text, subject, CASE WHEN id0 <> '' THEN id0 ELSE substr(sha1(substr(text, 1, 200)), 1, 12) END AS doc_id FROM picked",
    "fallback_doc_id": "SELECT doc_id, substr(sha1(substr(text, 1, 200)), 1, 12) AS sha12 FROM documents WHERE text IS NOT NULL",
    "random_access": "SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 1 OFFSET 2",
    "global_index": """SELECT corpus, key, (row_number() OVER (PARTITION BY corpus ORDER BY key) - 1)::INTEGER AS pos
        FROM (SELECT 'documents' AS corpus, doc_id::VARCHAR AS key FROM documents UNION ALL SELECT 'page_records', id FROM (SELECT DISTINCT id FROM page_records))""",
    "normalize_text": f"SELECT doc_id, {normalize('text', nfc=True)} AS text_norm FROM documents",
    "whitespace_normalize": f"SELECT doc_id, {strip(sub(unix(sub('text', r'[ \t\x{a0}]+', ' ')), r'\n{4,}', chr(10) * 3))} AS text_norm FROM documents",
    "unicode_nfc": "SELECT doc_id, nfc_normalize(text) AS nfc_text FROM documents",
    "unicode_issues": f"SELECT doc_id, {matches('text', r'[\x{FFFD}\p{Co}]')} AS has_issues, {matches('text', CJK)} AS has_cjk FROM documents WHERE text IS NOT NULL",
    "html_flags": f"SELECT doc_id, {matches('text', TAG)} AS has_html, {matches('text', RISKY_TAG)} AS risky FROM documents WHERE text IS NOT NULL",
    "strip_html": f"SELECT doc_id, {strip(sub('text', '<[^>]+>', ' '))} AS visible FROM documents",
    "escape_html": f"SELECT doc_id, {esc('text')} AS escaped FROM documents",
    "text_flags": f"SELECT doc_id, {flags('text')} AS flags FROM documents WHERE text IS NOT NULL",
    "flag_distribution": f"SELECT {flags('text')} AS flags, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "sentence_split": f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {sentences('text')} AS s FROM documents WHERE text IS NOT NULL)",
    "paragraph_split": f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS paragraph FROM (SELECT doc_id, {paragraphs(unix('text'))} AS s FROM documents WHERE text IS NOT NULL)",
    "paragraph_chunks": f"WITH {CHUNKS} SELECT doc_id, (generate_subscripts(chunks, 1) - 1)::INTEGER AS pos, unnest(chunks) AS chunk FROM chunked",
    "safe_boundaries": f"SELECT doc_id, {boundaries('text')} AS positions FROM documents WHERE text IS NOT NULL",
    "inline_math_test": f"""WITH p AS (SELECT id, unnest(b.parts) AS p FROM (SELECT id, unnest(blocks) AS b FROM page_records)), x AS (SELECT DISTINCT id, p.tex AS tex, {strip('p.tex')} AS i FROM p WHERE p.tex IS NOT NULL)
        SELECT id, tex, i <> '' AND NOT contains(i, chr(10)) AND length(i) <= 256 AND NOT {matches('i', _price)} AND ({matches('i', _command)} OR {matches('i', STRONG_SYMBOLS)} OR {matches('i', OPERATION)}) AS math, {matches('tex', _price)} AS price FROM x""",
    "math_subjects": f"SELECT coalesce(lower({strip('subject')}) IN ({', '.join(map(q, MATH_SUBJECTS))}), false) AS math_subject, count(*) AS n FROM page_records GROUP BY 1",
    "file_names": f"SELECT DISTINCT substr({sub('id', r'[^\p{L}\p{N}\-_.]', '_')}, 1, 120) AS name FROM page_records",
    "exact_dedup_first": f"WITH {TIDY} SELECT min(doc_id) AS doc_id, sha1 FROM tidy GROUP BY sha1",
    "dedup_counts": f"WITH {TIDY} SELECT count(*) AS total, count(DISTINCT sha1) AS kept, count(*) - count(DISTINCT sha1) AS skipped FROM tidy",
    "dedup_incremental": f"WITH {TIDY} SELECT min(doc_id) AS doc_id, sha1 FROM tidy WHERE added_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00' AND sha1 NOT IN (SELECT sha1 FROM tidy WHERE added_at < TIMESTAMPTZ '2025-07-01 00:00:00+00') GROUP BY sha1",
    "split_assign": f"SELECT id, {split('id')} AS split FROM {DISTINCT_PAGES}",
    "split_counts": f"SELECT {_SIMPLE_SPLIT} AS split, count(*) AS n, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM documents GROUP BY 1",
    "repackage_counts": f"""WITH {TIDY}, first AS (SELECT arg_min(text, doc_id) AS text, min(doc_id) AS doc_id FROM tidy GROUP BY sha1), r AS (SELECT {_SIMPLE_SPLIT} AS split, {flags('text')} AS f, length(text) AS n FROM first)
        SELECT split, count(*) AS n_pages, sum(n)::BIGINT AS chars, count(*) FILTER (f & 1 > 0) AS math, count(*) FILTER (f & 2 > 0) AS tables, count(*) FILTER (f & 4 > 0) AS html FROM r GROUP BY split""",
    "ingest_counters": f"""WITH {PICKED}, t AS (SELECT text, {normalize('text')} AS tidy FROM picked)
        SELECT count(*) AS documents, count(*) FILTER (tidy = '') AS empty, (count(*) FILTER (tidy <> '') - count(DISTINCT tidy) FILTER (tidy <> ''))::BIGINT AS copies, count(*) FILTER (tidy <> '' AND {matches('text', RISKY_TAG)}) AS risky FROM t""",
    "shard_round_robin": "SELECT ((k - 1) % 4)::INTEGER AS shard, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY doc_id) AS k FROM documents) GROUP BY 1",
    "shard_roll": f"""WITH RECURSIVE s AS (SELECT {_SIMPLE_SPLIT} AS split, doc_id, strlen(text) AS b FROM documents WHERE text IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS k FROM s),
        r AS (SELECT split, k, doc_id, b, 0 AS shard, b AS used FROM o WHERE k = 1 UNION ALL
              SELECT o.split, o.k, o.doc_id, o.b, r.shard + (r.used > 0 AND r.used + o.b > 65536)::INTEGER, CASE WHEN r.used > 0 AND r.used + o.b > 65536 THEN o.b ELSE r.used + o.b END FROM r JOIN o ON o.split = r.split AND o.k = r.k + 1)
        SELECT split, doc_id, b::INTEGER AS bytes, shard FROM r""",
    "epoch_shuffle": "SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id || ':3:42') NULLS FIRST, doc_id NULLS FIRST) - 1 AS pos FROM documents",
    "epoch_order": "SELECT e::INTEGER AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY sha256(doc_id || ':' || e || ':42') NULLS FIRST, doc_id NULLS FIRST) - 1 AS pos FROM documents, (SELECT unnest([1, 2]) AS e)",
    "ratio_interleave": f"""WITH n AS (SELECT greatest(1.0::DOUBLE, (SELECT count(*) FROM chat_rows) / ((SELECT count(*) FROM documents) * 0.2::DOUBLE / 0.8::DOUBLE)) AS scale),
        both_ AS (SELECT 'main' AS origin, doc_id AS key, {u60('doc_id::VARCHAR', 'main7')}::DOUBLE / {1 << 60}::DOUBLE AS place FROM documents
                  UNION ALL SELECT 'other', chat_id, {u60('chat_id::VARCHAR', 'other7')}::DOUBLE / {1 << 60}::DOUBLE * scale FROM chat_rows, n)
        SELECT origin, key, row_number() OVER (ORDER BY place, key, origin) - 1 AS pos FROM both_""",
    "ratio_replace": f"SELECT doc_id, CASE WHEN {u60('doc_id::VARCHAR', 7)} < {int(0.25 * (1 << 60))} THEN 'text' ELSE 'image' END AS kind FROM documents",
    "block_targets": f"""WITH b AS (SELECT id, unnest(blocks) AS b, (generate_subscripts(blocks, 1) - 1)::INTEGER AS pos FROM page_records), t AS (SELECT id, pos, b, {block_target('b')} AS target FROM b)
        SELECT DISTINCT id, pos, b.kind AS kind, target, (CASE b.kind WHEN 'paragraph' THEN greatest(1, length(target)) WHEN 'math_display' THEN greatest(140, floor(length(coalesce(b.tex, ''))::DOUBLE * 1.7::DOUBLE))
        WHEN 'table' THEN greatest(180, coalesce(len(b.rows), 0) * 85) ELSE 50 END)::INTEGER AS cost FROM t""",
    "page_targets": f"SELECT DISTINCT id, {JOINED} AS target FROM page_records WHERE blocks IS NOT NULL",
    "page_flags": f"SELECT DISTINCT id, {BLOCK_FLAGS} AS flags, {flags('target')} AS text_flags FROM (SELECT id, blocks, {JOINED} AS target FROM page_records WHERE blocks IS NOT NULL)",
    "pack_pages": f"WITH {CHUNKS}, {PACK} SELECT doc_id, page, count(*) AS n_blocks, sum(greatest(1, length(chunk)))::BIGINT AS cost FROM packed GROUP BY doc_id, page",
    "page_documents": f"""WITH h AS (SELECT id, '<!DOCTYPE html><html><head><meta charset="utf-8"><style>body{{width:1024px;height:512px;margin:0}}</style></head><body>' || array_to_string(list_filter({MARKUP_LIST}, lambda h: h <> ''), chr(10)) || '</body></html>' AS html
        FROM page_records WHERE blocks IS NOT NULL) SELECT DISTINCT id, html, sha1(html) AS digest FROM h""",
    "page_markup": f"SELECT DISTINCT id, {MARKUP} AS html, sha1({MARKUP}) AS digest FROM page_records WHERE blocks IS NOT NULL",
    "compact_json": "SELECT DISTINCT id AS i, target_text AS t, coalesce(subject, '') AS s, coalesce(flags, 0)::INTEGER AS f FROM page_records WHERE target_text <> ''",
    "page_manifest": "SELECT DISTINCT id, sha1(target_text) AS sha1 FROM page_records WHERE length(target_text) >= 20",
    "task_sample_hash": f"""SELECT CASE WHEN u < {int(0.6 * (1 << 60))} THEN 'full_ocr' WHEN u < {int(0.7 * (1 << 60))} THEN 'optical_continuation' WHEN u < {int(0.9 * (1 << 60))} THEN 'span_reconstruction' ELSE 'text_replay' END AS task, count(*) AS n
        FROM (SELECT {u60('id', 'task:0:42')} AS u FROM {DISTINCT_PAGES}) GROUP BY 1""",
    "task_source_text": "SELECT spec_id, coalesce(prefix_text, '') || coalesce(visual_text, '') || coalesce(suffix_text, '') AS source_text FROM task_specs",
    "continuation_lengths": f"""WITH b AS (SELECT doc_id, text, {boundaries('text')} AS b FROM documents WHERE length(text) >= 100), s AS (SELECT doc_id, text, b[2] AS a, coalesce(list_min(list_filter(b[3:], lambda x: x - b[2] >= 300)), list_max(b)) AS e FROM b WHERE len(b) >= 3)
        SELECT doc_id, length({strip('substr(text, 1, a)')})::INTEGER AS prefix_len, length({strip('substr(text, a + 1, e - a)')})::INTEGER AS visual_len, length({strip('substr(text, e + 1)')})::INTEGER AS suffix_len FROM s""",
    "task_sequences": f"WITH {SEQUENCES} SELECT spec_id, ids, labels FROM rows_",
    "vision_alignment": f"WITH {SEQUENCES} SELECT task_type, len(list_filter(ids, lambda x: x = 7)) = 64 AS aligned, count(*) AS n FROM rows_ GROUP BY 1, 2",
    "pad_batch_stats": f"""WITH {SEQUENCES}, b AS (SELECT *, ((row_number() OVER (ORDER BY spec_id) - 1) // 8)::INTEGER AS batch FROM rows_)
        SELECT batch, max(len(ids))::INTEGER AS max_len, (max(len(ids)) * count(*) - sum(len(ids)))::BIGINT AS padding, sum(len(ids))::BIGINT AS n_tokens, sum(n_labels)::BIGINT AS n_labels FROM b GROUP BY batch""",
    "pad_batches": f"""WITH {SEQUENCES}, b AS (SELECT *, ((row_number() OVER (ORDER BY spec_id) - 1) // 8)::INTEGER AS batch FROM rows_), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) - len(ids) AS short FROM b)
        SELECT spec_id, batch, list_concat(ids, list_transform(range(short), lambda i: 0::BIGINT)) AS input_ids, list_concat(labels, list_transform(range(short), lambda i: -100::BIGINT)) AS padded_labels,
        list_concat(list_transform(ids, lambda i: 1::BIGINT), list_transform(range(short), lambda i: 0::BIGINT)) AS attention_mask FROM m""",
    "cpt_first_answer": "SELECT chat_id, nullif(trim(list_filter(messages, lambda m: m.role = 'assistant')[1].content), '') AS caption, coalesce(len(images) > 0, false) AS has_image FROM chat_rows",
    "image_answer_sequence": f"""WITH c AS (SELECT chat_id, images, nullif(trim(list_filter(messages, lambda m: m.role = 'assistant')[1].content), '') AS c FROM chat_rows), a AS (SELECT chat_id, list_concat({ids('substr(c, 1, 189)')}, [1::BIGINT]) AS a FROM c WHERE c IS NOT NULL AND len(images) > 0)
        SELECT chat_id, list_concat({_image}, a) AS ids, list_concat(list_transform({_image}, lambda x: -100::BIGINT), a) AS labels FROM a""",
    "chatml_sequence": chat(),
    "text_only_sequence": f"WITH t AS (SELECT doc_id, {strip('text')} AS t FROM documents) SELECT doc_id, list_concat({ids('t')}[1:511], [1::BIGINT]) AS ids, list_concat({ids('t')}[1:511], [1::BIGINT]) AS labels FROM t WHERE length(t) >= 20",
    "placeholder_expansion": """SELECT DISTINCT chat_id, m.content AS content, CASE WHEN (length(m.content) - length(replace(m.content, '<image>', ''))) // 7 = 1 THEN replace(m.content, '<image>', '<image><image><image>') END AS expanded
        FROM (SELECT chat_id, unnest(messages) AS m FROM chat_rows) WHERE m.role = 'user' AND m.content IS NOT NULL""",
    "doc_to_vocab": f"WITH {CHARS} SELECT ch, n FROM chars",
    "vocab_new_chars": f"WITH {CHARS}, {VOCAB} SELECT ch, n FROM chars WHERE ch NOT IN (SELECT token FROM vocab)",
    "vocab_coverage": f"WITH {CHARS}, {VOCAB} SELECT count(*) AS n_chars, count(v.token) AS n_known, sum(n)::BIGINT AS n_occurrences, coalesce(sum(n) FILTER (v.token IS NOT NULL), 0)::BIGINT AS n_covered FROM chars LEFT JOIN vocab v ON v.token = ch",
    "vocab_extended": f"""WITH {CHARS}, {VOCAB} SELECT token, id FROM vocab UNION ALL
        SELECT ch, (row_number() OVER (ORDER BY n DESC, ch) - 1 + (SELECT count(*) FROM vocab))::INTEGER FROM chars WHERE ch NOT IN (SELECT token FROM vocab)""",
    "char_tokenize": f"""WITH {VOCAB}, m AS (SELECT map(list(token), list(id)) AS m FROM vocab)
        SELECT doc_id, CASE WHEN length(text) > 0 THEN list_transform(string_split(text, ''), lambda c: coalesce(m[c], 2)) ELSE []::INTEGER[] END AS ids FROM documents, m WHERE text IS NOT NULL""",
    "char_round_trip": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL",
    "canvas_size": f"WITH {MEASURED}, {CANVAS} SELECT doc_id, width, height, width // 32 AS grid_w, height // 32 AS grid_h, (width // 32) * (height // 32) AS visual_tokens, overflow FROM canvas",
    "bucket_choice": f"WITH {MEASURED}, b AS (SELECT doc_id, list_min(list_filter({BUCKETS}, lambda x: x >= content_h + 32)) AS height FROM measured) SELECT doc_id, height, CASE WHEN height IS NULL THEN 'needs_split' END AS reject_reason FROM b",
    "width_candidates": """SELECT DISTINCT id, array_to_string(list_filter([1024, 896, 768, 640, 512, 384, 256], lambda w: w >= least_), ',') AS widths FROM (SELECT id, CASE WHEN len(list_filter(blocks, lambda b: b.kind = 'table')) > 0 THEN 768
        WHEN len(list_filter(blocks, lambda b: b.kind = 'math_display')) > 0 THEN 512 ELSE 0 END AS least_ FROM page_records WHERE blocks IS NOT NULL)""",
    "smart_resize": f"""WITH g AS (SELECT DISTINCT (l_partkey % 3000 + 1)::INTEGER AS h, (l_orderkey % 4000 + 1)::INTEGER AS w FROM lineitem),
        s AS (SELECT h, w, greatest(32, (round_even(h / 32.0::DOUBLE, 0) * 32)::INTEGER) AS h1, greatest(32, (round_even(w / 32.0::DOUBLE, 0) * 32)::INTEGER) AS w1 FROM g)
        SELECT h, w, CASE WHEN h1 * w1 > 3200000 THEN {_snap(f'(h / {_down})', 'floor')} WHEN h1 * w1 < 50176 THEN {_snap(f'(h * {_up})', 'ceil')} ELSE h1 END AS height,
        CASE WHEN h1 * w1 > 3200000 THEN {_snap(f'(w / {_down})', 'floor')} WHEN h1 * w1 < 50176 THEN {_snap(f'(w * {_up})', 'ceil')} ELSE w1 END AS width FROM s""",
    "coordinates_2d": """WITH g(grid_h, grid_w) AS (VALUES (2, 8), (4, 16), (8, 16), (16, 32), (6, 24)), r AS (SELECT grid_h, grid_w, unnest(range(grid_h))::INTEGER AS row FROM g), c AS (SELECT *, unnest(range(grid_w))::INTEGER AS col FROM r)
        SELECT grid_h::INTEGER AS grid_h, grid_w::INTEGER AS grid_w, row, col, round(col::DOUBLE / (grid_w - 1), 9) AS x, round(row::DOUBLE / (grid_h - 1), 9) AS y FROM c""",
    "font_stacks": r"""SELECT '"Times New Roman"' || CASE WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]') THEN ', "Noto Sans CJK SC"' ELSE '' END || ', serif' AS stack, count(*) AS n
        FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "bucket_batches": f"""WITH {MEASURED}, {CANVAS}, o AS (SELECT doc_id, height // 32 AS grid_h, width // 32 AS grid_w FROM canvas),
        k AS (SELECT *, ((row_number() OVER (PARTITION BY grid_h, grid_w ORDER BY sha256(doc_id || ':42'), doc_id) - 1) // 4)::INTEGER AS batch FROM o) SELECT doc_id, grid_h, grid_w, batch FROM k""",
    "lr_schedule": """SELECT step, round(CASE WHEN step < 100 THEN greatest(1e-8, step / 100.0::DOUBLE) ELSE greatest(0.1::DOUBLE, 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (step - 100) / 900.0::DOUBLE)))) END, 9) AS cosine,
        round(CASE WHEN step < 100 THEN greatest(1e-8, step / 100.0::DOUBLE) ELSE greatest(0.1::DOUBLE, 1 - (step - 100) / 900.0::DOUBLE) END, 9) AS linear,
        round(CASE WHEN step < 100 THEN greatest(1e-8, step / 100.0::DOUBLE) ELSE 1.0::DOUBLE END, 9) AS "constant" FROM (SELECT unnest(range(1001)) AS step)""",
    "curriculum_phase": """SELECT step, CASE WHEN step < 50000 THEN 1 WHEN step < 100000 THEN 2 ELSE 3 END AS phase, (CASE WHEN step < 50000 THEN 0.8 WHEN step < 100000 THEN 0.55 ELSE 0.4 END)::DOUBLE AS clean,
        (CASE WHEN step < 50000 THEN 0.18 WHEN step < 100000 THEN 0.35 ELSE 0.4 END)::DOUBLE AS mild, (CASE WHEN step < 50000 THEN 0.02 WHEN step < 100000 THEN 0.1 ELSE 0.2 END)::DOUBLE AS hard FROM (SELECT unnest(range(0, 200000, 500)) AS step)""",
    "steps_per_epoch": "SELECT b::INTEGER AS batch, n AS samples, ceil(n / b)::BIGINT AS steps FROM (SELECT count(*) AS n FROM documents), (SELECT unnest([32, 256, 512]) AS b)",
    "validate_records": f"SELECT id, unnest({ISSUES}) AS issue FROM (SELECT DISTINCT id, target_text AS t FROM page_records)",
    "validate_manifest": f"""SELECT source, count(*) AS total, count(*) FILTER (len(i) = 0) AS valid, count(*) FILTER (len(i) > 0) AS invalid, count(*) FILTER (list_contains(i, 'empty target_text')) AS empty_text, round(avg(n), 6) AS avg_len, max(n)::INTEGER AS max_len, min(n)::INTEGER AS min_len
        FROM (SELECT source, {ISSUES} AS i, coalesce(length(t), 0) AS n FROM (SELECT id, source, target_text AS t FROM page_records)) GROUP BY source""",
    "issue_top20": f"SELECT issue, count(*) AS n FROM (SELECT unnest({ISSUES}) AS issue FROM (SELECT id, target_text AS t FROM page_records)) GROUP BY issue ORDER BY n DESC, issue LIMIT 20",
    "percentiles_linear": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY event_type",
    "p95_floor": "SELECT event_type, list_sort(list(value))[(least(floor(0.95 * count(*)), count(*) - 1) + 1)::INTEGER] AS p_floor FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "size_distribution": f"WITH {MEASURED}, b AS (SELECT list_min(list_filter({BUCKETS}, lambda x: x >= content_h)) AS bucket FROM measured) SELECT bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM b GROUP BY bucket",
    "stage_throughput": "SELECT event_type, round(1000.0 / avg(value), 6) AS samples_per_s FROM events WHERE value > 0 GROUP BY event_type",
    "scaling_efficiency": """WITH r AS (SELECT user_id % 8 + 1 AS workers, count(*)::DOUBLE AS t FROM events GROUP BY 1)
        SELECT workers, round(t / first_value(t) OVER (ORDER BY workers), 9) AS speedup, round(t * first_value(workers) OVER (ORDER BY workers) / (first_value(t) OVER (ORDER BY workers) * workers), 9) AS efficiency FROM r""",
    "recycle_rows": "SELECT example_id, area, count(*) AS n FROM (SELECT example_id, area FROM area_examples, (SELECT unnest(range(500)) AS r) ORDER BY r, example_id LIMIT 500) GROUP BY example_id, area",
    "retention": "SELECT doc_id FROM documents WHERE added_at IS NOT NULL ORDER BY doc_id DESC LIMIT 5",
    "stream_dedup": f"SELECT count(DISTINCT sha1) AS n, count(DISTINCT sha1) AS n_distinct FROM (SELECT sha1({normalize('text')}) AS sha1 FROM documents WHERE length(text) > 0)",
    "compact_pages": f"""WITH {CHUNKS_NFC}, {PACK}, p AS (SELECT doc_id, any_value(subject) AS subject, page, {strip('array_to_string(list(chunk ORDER BY k), chr(10))')} AS t FROM packed GROUP BY doc_id, page)
        SELECT doc_id || '-p' || lpad(page::VARCHAR, 5, '0') AS i, t, coalesce(subject, '') AS s, {flags('t')} AS f FROM p WHERE t <> ''""",
    "raw_scan_objects": f"""WITH {LINES}, made(source_file, line_no, text) AS (VALUES ('made', 1, 'only words'), ('made', 2, '17'), ('made', 3, '["a","b"]'), ('made', 4, 'x')),
        good AS (SELECT source_file, line_no, line::JSON AS j FROM lines WHERE json_valid(line))
        SELECT source_file, line_no, CASE json_type(j) WHEN 'OBJECT' THEN json_extract(j, '$.text') ->> '$' ELSE j ->> '$' END AS text FROM good UNION ALL SELECT source_file, line_no::BIGINT, text FROM made""",
    "compact_rejects": f"""WITH {LINES} SELECT 'pages' AS source_file, CASE WHEN coalesce(target_text, '') = '' THEN 'empty' ELSE 'ok' END AS reason, count(*) AS n FROM page_records GROUP BY 1, 2
        UNION ALL SELECT source_file, CASE WHEN NOT json_valid(line) THEN 'malformed' WHEN coalesce(json_extract(CASE WHEN json_valid(line) THEN line END, '$.t') ->> '$', '') = '' THEN 'empty' ELSE 'ok' END, count(*) FROM lines GROUP BY 1, 2""",
    "file_lines": "SELECT folder, line, count(*) AS n FROM raw_records, (SELECT unnest(['a', 'b']) AS folder) WHERE NOT contains(line, chr(13)) GROUP BY 1, 2",
    "row_estimate": "SELECT count(*) AS n FROM raw_records WHERE NOT contains(line, chr(13))",
    "whole_json": f"""WITH {LINES}, good AS (SELECT source_file, line_no, line::JSON AS j FROM lines WHERE json_valid(line))
        SELECT md5(source_file) AS file, (row_number() OVER (PARTITION BY source_file ORDER BY line_no, j::VARCHAR) - 1)::INTEGER AS record_index, CASE WHEN json_type(j) = 'OBJECT' THEN json_extract(j, '$.text') ->> '$' END AS text FROM good""",
    "vocabulary_file": f"WITH {VOCAB} SELECT token, id FROM vocab",
    "split_folders": f"SELECT DISTINCT id, doc_id, page_index, subject, len(blocks)::INTEGER AS n_blocks, sha1({JOINED}) AS blocks_sha1, target_text, has_math, has_table, flags, split FROM page_records WHERE split IS NOT NULL",
    "build_counters": f"""WITH {TIDY}, kept AS (SELECT min(doc_id) AS doc_id FROM tidy GROUP BY sha1), {CHUNKS_NFC}, {PACK},
        p AS (SELECT doc_id, {strip('array_to_string(list(chunk ORDER BY k), chr(10))')} AS t FROM packed WHERE doc_id IN (SELECT doc_id FROM kept) GROUP BY doc_id, page), q AS (SELECT {_SIMPLE_SPLIT} AS split, t, {flags('t')} AS f FROM p WHERE t <> '')
        SELECT (SELECT count(*) FROM documents) AS docs_seen, (SELECT count(*) FROM documents) - (SELECT count(*) FROM tidy) AS empty, (SELECT count(*) FROM tidy) - (SELECT count(*) FROM kept) AS dedup_skipped, (SELECT count(*) FROM kept) AS docs_processed,
        count(*) AS pages, count(*) FILTER (split = 'train') AS pages_train, count(*) FILTER (split = 'val') AS pages_val, count(*) FILTER (split = 'test') AS pages_test, count(*) FILTER (f & 1 > 0) AS math_pages, count(*) FILTER (f & 2 > 0) AS table_pages, count(*) FILTER (length(t) < 20) AS short_pages FROM q""",
    "stream_windows": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2",
    "parse_cases": r"""SELECT * FROM (VALUES (0, 0, 'paragraph', 'One.'), (0, 1, 'paragraph', 'Two \(x=1\) costs $5.'), (1, 0, 'paragraph', 'A'), (1, 1, 'math_display', '\[a+b\]'), (1, 2, 'paragraph', 'B \(c\)'),
        (2, 0, 'math_display', '\[x\]'), (3, 0, 'paragraph', '\(y^2\)'), (3, 1, 'paragraph', 'tail'), (4, 0, 'table', 'a' || chr(9) || 'b' || chr(10) || '1' || chr(9) || '2'), (4, 1, 'paragraph', 'after'),
        (5, 0, 'paragraph', 'One two'), (5, 1, 'table', 'a' || chr(9) || 'b'), (6, 0, 'paragraph', 'only & text'), (7, 0, 'paragraph', 'bold in out'), (8, 0, 'paragraph', 'price $10 and $20'), (9, 0, 'paragraph', 'a | b' || chr(10) || 'no rule'),
        (11, 0, 'math_display', '\[x\]'), (11, 1, 'math_display', '\[y\]')) v(doc_id, pos, kind, target)""",
}
