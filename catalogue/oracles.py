"""The queries in SQL, written from the definitions and not from the Spark expressions."""

from __future__ import annotations

# Unicode white space, as a class body and as characters.
_WHITE = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_WS, _SOLID = f"[{_WHITE}]", f"[^{_WHITE}]"
_WS_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
_WS_CHARS = "'" + "".join(map(chr, _WS_POINTS)) + "'"

# Inputs -------------------------------------------------------------------------------


def _choice(key: str, modulus: int, *choices: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"CASE {key} % {modulus} {whens} END"


def _bill(vendor: str) -> str:
    head = f"CASE WHEN o_orderkey % 11 = 0 THEN 'ab' ELSE {vendor} END"
    invoice = (
        "'Invoice Number: INV-' || o_orderkey || chr(10) || 'Bill To: Account ' || o_custkey"
    )
    receipt = (
        "'Receipt ' || o_orderkey || chr(10) || 'Terminal 12 Cash 500.00 Change Due: 3.50'"
    )
    body = _choice("o_orderkey", 7, invoice, invoice, invoice, "'Tax invoice'", receipt, receipt,
                   "'Statement of account'")
    day = _choice(
        "o_orderkey", 6,
        "'Invoice Date: ' || strftime(o_orderdate, '%m/%d/%Y')",
        "'Date: ' || strftime(o_orderdate, '%Y-%m-%d')",
        "'Dated: ' || strftime(o_orderdate, '%b %-d, %Y')",
        "'Bill Date: ' || strftime(o_orderdate, '%-m/%-d/%y')",
        "'Issued ' || strftime(o_orderdate, '%-d/%-m/%Y')",
        "'Period without a day'",
    )
    due = "'Due Date: ' || strftime(o_orderdate + INTERVAL 30 DAY, '%m/%d/%Y')"
    money = "format('{{:,.2f}}', {})".format
    full = (
        f"'Subtotal: $' || {money('floor(o_totalprice * 0.9::DOUBLE)')} || chr(10) || "
        f"'Tax: $' || {money('floor(o_totalprice * 0.1::DOUBLE)')} || chr(10) || "
        f"'Total: $' || {money('o_totalprice')}"
    )
    plain = "'Total: ' || (o_totalprice::DECIMAL(12,2))::VARCHAR"
    total = _choice("o_orderkey", 9, plain, "'Thank you'", *[full] * 7)
    return " || chr(10) || ".join(f"({part})" for part in (head, body, day, due, total))


_BILLS = (
    "bills AS (SELECT o_orderkey AS doc_id, "
    + _bill("'Trading House ' || o_custkey")
    + " AS text FROM orders)"
)
_CUSTOMER_BILLS = (
    "bills AS (SELECT o_orderkey AS doc_id, 'bill_' || o_orderkey || '.jpg' AS file_path, "
    + _bill("c_name")
    + " AS text FROM orders JOIN customer ON o_custkey = c_custkey)"
)
_CORPUS = "bills AS (SELECT doc_id, text FROM documents)"

# Text ---------------------------------------------------------------------------------

_INVOICE_WORDS = ("invoice", "bill to", "due date", "invoice number", "inv#")
_RECEIPT_WORDS = ("receipt", "ticket", "change due", "cash", "terminal", "pos")


def _score(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


_TYPED = f"""
scored AS (SELECT doc_id, {_score(_INVOICE_WORDS)} AS i, {_score(_RECEIPT_WORDS)} AS r FROM bills),
typed AS (SELECT doc_id,
  CASE WHEN i > r OR (i = r AND i > 0) THEN 'invoice' WHEN r > i THEN 'receipt'
       ELSE 'unknown' END AS doc_type,
  CASE WHEN i = r AND i > 0 THEN 0.5::DOUBLE WHEN i = r THEN 0.0::DOUBLE
       ELSE least(0.5::DOUBLE + greatest(i, r) * 0.1::DOUBLE, 0.99::DOUBLE) END AS confidence
  FROM scored)"""


def _pieces(name: str, pattern: str) -> str:
    """Text cut at the matches: even pieces are matches, odd ones what lies between."""
    return (
        f"{name} AS (SELECT doc_id, string_split(regexp_replace(text, '({pattern})', "
        f"chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM bills)"
    )


def _matches(name: str, source: str, window: int) -> str:
    """A row per match with the lower-cased characters to its left."""
    return f"""
{name} AS (SELECT doc_id, c.i AS i, c.raw AS raw, c.ctx AS ctx FROM (
  SELECT doc_id, unnest(list_transform(range(2, len(p) + 1, 2), lambda i: {{
    'i': i, 'raw': p[i],
    'ctx': lower(right(array_to_string(p[greatest(1, i - {2 * window}):i - 1], ''), {window}))
  }})) AS c FROM {source}))"""


_DATE = (
    "[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}|"
    f"[A-Za-z]{{3}}{_WS}[0-9]{{1,2}},{_WS}[0-9]{{4}}"
)
_DATES = (
    _pieces("date_pieces", _DATE) + "," + _matches("date_matches", "date_pieces", 20) + f""",
date_parts AS (SELECT *, string_split(replace(raw, '-', '/'), '/') AS s FROM date_matches),
date_scored AS (SELECT doc_id, i,
  CASE WHEN contains(ctx, 'invoice date') OR contains(ctx, 'date:') OR contains(ctx, 'dated:')
         OR contains(ctx, 'bill date') THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS score,
  CASE WHEN regexp_matches(raw, '^[A-Za-z]')
    THEN try_strptime(regexp_replace(raw, '{_WS}', ' ', 'g'), '%b %d, %Y')::DATE
    WHEN length(s[1]) = 4 THEN try_cast(s[1] || '-' || s[2] || '-' || s[3] AS DATE)
    WHEN length(s[3]) = 3 THEN NULL
    ELSE try_cast(
      CASE WHEN length(s[3]) = 4 THEN s[3] WHEN s[3]::INT < 69 THEN '20' || s[3]
           ELSE '19' || s[3] END || '-' ||
      CASE WHEN s[1]::INT > 12 THEN s[2] || '-' || s[1] ELSE s[1] || '-' || s[2] END AS DATE)
  END AS value FROM date_parts),
date_best AS (SELECT doc_id, value, score FROM date_scored WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1)"""
)

_NUMBER = r"[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?"
_AMOUNT = rf"[$€£₹]?{_WS}?{_NUMBER}"
_TOTAL_WORDS = ("total", "grand total", "amount due", "balance due")
_NEAR_TOTAL = " OR ".join(f"contains(ctx, '{w}')" for w in _TOTAL_WORDS)
_AMOUNTS = (
    _pieces("amount_pieces", _AMOUNT) + "," + _matches("amount_matches", "amount_pieces", 40) + f""",
amount_scored AS (SELECT doc_id,
  CASE WHEN {_NEAR_TOTAL} THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS score,
  regexp_replace(raw, '[^0-9.]', '', 'g')::DOUBLE AS value FROM amount_matches),
amount_best AS (SELECT doc_id, value, score FROM amount_scored WHERE value >= 0.01
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, value DESC) = 1)"""
)
_PLAIN_AMOUNT = rf"[$€£₹]?{_WS}?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]{{2}})?"

_LINES = f"""
lines AS (SELECT doc_id, pos, line FROM (
  SELECT doc_id, unnest(list_transform(string_split(text, chr(10)),
                        lambda l: trim(l, {_WS_CHARS}))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM bills)
  WHERE length(line) > 3),
first_lines AS (SELECT doc_id, arg_min(line, pos) AS line FROM lines GROUP BY doc_id)"""

_SUMMARY = f"""
sentences AS (SELECT doc_id, pos, s, regexp_matches(s, '\\p{{Nd}}') AS digit FROM (
  SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '[.!?\\n]+'),
                        lambda x: trim(x, {_WS_CHARS}))) AS s,
         generate_subscripts(regexp_split_to_array(text, '[.!?\\n]+'), 1) AS pos FROM bills)
  WHERE length(s) > 20),
picked AS (SELECT doc_id, s,
  row_number() OVER (PARTITION BY doc_id ORDER BY digit DESC, pos) AS n
  FROM sentences QUALIFY n <= 3),
summaries AS (SELECT b.doc_id, coalesce(string_agg(s, ' | ' ORDER BY n),
  'No text content sufficiently long to summarize.') AS summary
  FROM bills b LEFT JOIN picked USING (doc_id) GROUP BY b.doc_id)"""

_EXTRACTED = f"""
extracted AS (SELECT b.doc_id, t.confidence AS classification_confidence, s.summary,
  l.line AS vendor, CASE WHEN l.line IS NULL THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END AS vendor_conf,
  d.value AS date, coalesce(d.score, 0.0::DOUBLE) AS date_conf,
  a.value AS amount, coalesce(a.score, 0.0::DOUBLE) AS amount_conf, t.doc_type
  FROM bills b JOIN typed t USING (doc_id) JOIN summaries s USING (doc_id)
  LEFT JOIN first_lines l USING (doc_id) LEFT JOIN date_best d USING (doc_id)
  LEFT JOIN amount_best a USING (doc_id))"""
_ALL_FIELDS = ",".join((_TYPED, _DATES, _AMOUNTS, _LINES, _SUMMARY, _EXTRACTED))

# Known names: a word of the first 500 characters equal to a customer name, punctuation aside.
_MENTIONS = f"""
words AS (SELECT doc_id, pos, word FROM (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
    SELECT doc_id, list_filter(list_transform(
      regexp_split_to_array(lower(CASE WHEN length(text) > 500
        THEN regexp_replace(left(text, 501), '{_SOLID}*$', '') ELSE text END), '{_WS}+'),
      lambda x: regexp_replace(x, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')),
      lambda x: x <> '') AS w FROM bills))),
mentions AS (SELECT doc_id, arg_min(c_name, pos) AS vendor
  FROM words JOIN customer ON word = lower(c_name) GROUP BY doc_id)"""

# Evaluation ---------------------------------------------------------------------------

_LABELS = """
labels_once AS (SELECT o_orderkey AS k,
  CASE WHEN o_orderkey % 17 = 0 THEN 'missing.jpg' ELSE 'bill_' || o_orderkey || '.jpg' END
    AS file_path,
  CASE WHEN o_orderkey % 10 <> 3 THEN upper(c_name) END AS gt_vendor,
  CASE WHEN o_orderkey % 10 <> 4 THEN o_orderdate::DATE END AS gt_date,
  CASE WHEN o_orderkey % 10 <> 5 THEN o_totalprice END AS gt_amount,
  CASE WHEN o_orderkey % 7 < 4 THEN 'invoice' ELSE 'receipt' END AS gt_type
  FROM orders JOIN customer ON o_custkey = c_custkey),
truth AS (SELECT * FROM labels_once UNION ALL SELECT * FROM labels_once WHERE k % 13 = 0)"""
_COMPARED = f"""
WITH {_CUSTOMER_BILLS}, {_ALL_FIELDS}, {_LABELS},
predicted AS (SELECT b.file_path, b.doc_id % 19 <> 0 AS success, (b.doc_id % 40)::DOUBLE AS ms,
  CASE WHEN success THEN e.vendor END AS pred_vendor, CASE WHEN success THEN e.date END AS pred_date,
  CASE WHEN success THEN e.amount END AS pred_amount,
  CASE WHEN success THEN e.doc_type END AS pred_type
  FROM bills b JOIN extracted e USING (doc_id)),
compared AS (SELECT p.*, gt_vendor, gt_date, gt_amount,
  coalesce(contains(lower(pred_vendor), lower(gt_vendor))
           OR contains(lower(gt_vendor), lower(pred_vendor)), false) AS vendor_match,
  coalesce(pred_date = gt_date, false) AS date_match,
  coalesce(abs(gt_amount - pred_amount) / abs(gt_amount) < 0.01, false) AS amount_match,
  coalesce(pred_type = gt_type, false) AS doc_type_match
  FROM truth t JOIN predicted p USING (file_path)),
counted AS (SELECT count(*) AS n, count(*) FILTER (NOT success) AS failed,
  count(*) FILTER (doc_type_match) AS types, avg(ms) FILTER (success) AS ms,
  """ + ", ".join(
    f"count(*) FILTER ({f}_match) AS {f}_tp, "
    f"count(*) FILTER (success AND NOT {f}_match AND pred_{f} IS NOT NULL) AS {f}_fp, "
    f"count(*) FILTER (success AND NOT {f}_match AND gt_{f} IS NOT NULL) AS {f}_fn"
    for f in ("vendor", "date", "amount")
) + " FROM compared)"
_BY_FIELD = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {f}_tp AS tp, {f}_fp AS fp, {f}_fn AS fn FROM counted"
    for f in ("vendor", "date", "amount")
)

# Tokens -------------------------------------------------------------------------------

_TOKENS = """
tokens AS (SELECT doc_id, pos, (pos // 200)::INT AS page, word,
  ((pos % 200) // 10) * 12 AS y, ((pos * 7) % 5) * 50 AS x FROM (
    SELECT doc_id, unnest(string_split(text, ' ')) AS word,
           generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents))"""
_READ = """
read AS (SELECT doc_id, page, count(*) AS tokens,
  string_agg(word, ' ' ORDER BY y, x, pos) AS full_text FROM tokens GROUP BY doc_id, page)"""
_TWO_ENGINES = """
chosen AS (SELECT doc_id, page, pos, y, x,
    CASE WHEN (doc_id + page) % 5 <> 0 THEN word ELSE lower(word) END AS word,
    CASE WHEN (doc_id + page) % 5 <> 0 THEN 'easyocr' ELSE 'tesseract_fallback' END AS engine
  FROM tokens WHERE (doc_id + page) % 15 <> 0),
listed AS (SELECT DISTINCT doc_id, page,
  CASE WHEN (doc_id + page) % 5 <> 0 THEN 'easyocr' ELSE 'tesseract_fallback' END AS engine
  FROM tokens),
page_texts AS (SELECT l.doc_id, l.page, l.engine, count(c.pos) AS tokens,
  coalesce(string_agg(c.word, ' ' ORDER BY y, x, pos), '') AS full_text
  FROM listed l LEFT JOIN chosen c ON l.doc_id = c.doc_id AND l.page = c.page
  GROUP BY l.doc_id, l.page, l.engine)"""


def _documents(pages: str, engine: str) -> str:
    return (
        f"SELECT doc_id, {engine} AS engine, count(*) AS pages, sum(tokens)::BIGINT AS tokens, "
        f"md5(string_agg(full_text, chr(10) ORDER BY page)) AS text_md5 "
        f"FROM {pages} GROUP BY doc_id"
    )


# Annotations --------------------------------------------------------------------------


def _box(x_min: str, y_min: str, x_max: str, y_max: str) -> str:
    named = zip(("x_min", "y_min", "x_max", "y_max"), (x_min, y_min, x_max, y_max))
    return ", ".join(f"round(({value})::DOUBLE, 6) AS {name}" for name, value in named)


_W = "(o_custkey % 300)"
_IMG = "'img_' || o_orderkey || '.jpg' AS image_path"
_XML_BOXES = f"""
SELECT {_IMG}, 'invoice' AS label, 'cvat' AS source_tool, {_box('10', '20.5', _W, '460')},
  CASE WHEN o_orderkey % 2 = 1 THEN 'true' ELSE 'false' END AS occluded, '640.0' AS image_width,
  '480.0' AS image_height, o_orderstatus AS status FROM orders
UNION ALL
SELECT {_IMG}, 'field', 'cvat', {_box('0', '1', '2', '3')}, 'false', '640.0', '480.0', NULL
FROM orders"""
_XML_SHAPES = f"""
SELECT {_IMG}, 'stamp' AS label, 'cvat' AS source_tool,
  {_box(f'least(100, {_W})', '100', 'greatest(150, ' + _W + ')', f'greatest(100, {_W})')},
  'polygon' AS type FROM (SELECT * FROM orders WHERE o_custkey % 300 >= 100)
UNION ALL
SELECT {_IMG}, 'stamp', 'cvat', {_box(_W, _W, '150', '100')}, 'polygon'
FROM (SELECT * FROM orders WHERE o_custkey % 300 < 100)
UNION ALL
SELECT {_IMG}, 'unknown', 'cvat', {_box('5', '5', '7', '9')}, 'polyline' FROM orders"""
_JSON_PATH = (
    "CASE WHEN o_orderkey % 3 = 0 THEN 'ocr_' || o_orderkey ELSE 'img_' || o_orderkey END"
)
_P = "(o_custkey % 50)"
_NO_BOX = ", ".join(f"NULL::DOUBLE AS {c}" for c in ("x_min", "y_min", "x_max", "y_max"))
_JSON_RECORDS = f"""
SELECT {_JSON_PATH} AS image_path,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE 'invoice' END AS label,
  'label_studio' AS source_tool,
  {_box(f'{_P} / 100 * 640', '4 / 100 * 480', f'{_P} / 100 * 640 + 320', '4 / 100 * 480 + 92 / 100 * 480')},
  '0' AS rotation, NULL AS type FROM orders
UNION ALL
SELECT {_JSON_PATH}, 'stamp', 'label_studio',
  {_box(f'least(1, {_P}) * 2', '2', f'greatest(1, {_P}) * 2', '50')}, NULL, 'polygon' FROM orders
UNION ALL
SELECT {_JSON_PATH}, 'unknown', 'label_studio', {_NO_BOX}, NULL, NULL
FROM orders WHERE o_orderkey % 5 = 0
UNION ALL
SELECT {_JSON_PATH}, unnest([o_orderstatus, 'c', 'unknown']), 'label_studio', {_NO_BOX}, NULL, NULL
FROM orders WHERE o_orderkey % 5 > 1"""
_XML_FILES = f"""
SELECT {_IMG}, 'invoice' AS label, 'cvat' AS source_tool, {_box('10', '20.5', _W, '460')},
  NULL AS type, NULL AS source FROM orders WHERE o_orderkey % 31 <> 0 AND o_orderkey % 41 <> 0
UNION ALL
SELECT {_IMG}, 'field', 'cvat', {_box('0', '1', '2', '3')}, NULL, NULL
FROM orders WHERE o_orderkey % 41 <> 0
UNION ALL
SELECT {_IMG}, 'stamp', 'cvat',
  {_box(f'least(100, {_W})', f'least(100, {_W})', f'greatest(150, {_W})', f'greatest(100, {_W})')},
  'polygon', NULL FROM orders WHERE o_orderkey % 41 <> 0
UNION ALL
SELECT {_IMG}, 'unknown', 'cvat', {_box('5', '5', '7', '9')}, 'polyline', NULL
FROM orders WHERE o_orderkey % 37 <> 0 AND o_orderkey % 41 <> 0
UNION ALL
SELECT 'frame_' || p_size, lower(p_type), 'cvat', {_box('1', '2', '3', '4')}, NULL, 'manual'
FROM part WHERE p_partkey % 29 <> 0
UNION ALL
SELECT 'frame_0', lower(p_type), 'cvat', {_box('p_size', '0', '9', '9')}, NULL, 'manual' FROM part"""
_XML_REJECTS = f"""
WITH bad AS (SELECT *, o_orderkey % 31 = 0 AS box, o_orderkey % 37 = 0 AS points,
  o_orderkey % 41 = 0 AS tall FROM orders)
SELECT {_IMG}, 'invoice' AS label, 'cvat' AS source_tool,
  concat_ws(',', CASE WHEN box THEN 'ybr' END, CASE WHEN tall THEN 'height' END) AS unreadable
FROM bad WHERE box OR tall
UNION ALL
SELECT {_IMG}, unnest(['field', 'stamp', 'dot']), 'cvat', 'height' FROM bad WHERE tall
UNION ALL
SELECT {_IMG}, 'unknown', 'cvat',
  concat_ws(',', CASE WHEN points THEN 'points' END, CASE WHEN tall THEN 'height' END)
FROM bad WHERE points OR tall
UNION ALL
SELECT 'frame_' || p_size, lower(p_type), 'cvat', 'xbr' FROM part WHERE p_partkey % 29 = 0"""
_JSON_FILES = f"""
SELECT * FROM ({_JSON_RECORDS.replace("'0' AS rotation, NULL AS type FROM orders",
    "'0' AS rotation, NULL AS type FROM orders WHERE o_orderkey % 31 <> 0 AND o_orderkey % 41 <> 0")
    .replace("NULL, 'polygon' FROM orders", "NULL, 'polygon' FROM orders WHERE o_orderkey % 37 <> 0")})"""
_JSON_REJECTS = f"""
SELECT {_JSON_PATH} AS image_path,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE 'invoice' END AS label,
  'label_studio' AS source_tool,
  concat_ws(',', CASE WHEN o_orderkey % 31 = 0 THEN 'width' END,
    CASE WHEN o_orderkey % 41 = 0 THEN 'original_height' END) AS unreadable
FROM orders WHERE o_orderkey % 31 = 0 OR o_orderkey % 41 = 0
UNION ALL
SELECT {_JSON_PATH}, 'stamp', 'label_studio', 'points' FROM orders WHERE o_orderkey % 37 = 0"""
_CLASS = """CASE l_linenumber WHEN 1 THEN 'receipt' WHEN 2 THEN 'field_vendor'
  WHEN 3 THEN 'field_date' WHEN 4 THEN 'field_amount' ELSE 'class_' || l_linenumber END"""
_GOOD_LINES = "(SELECT * FROM lineitem WHERE l_orderkey % 23 <> 0)"

# Reports ------------------------------------------------------------------------------

_REQUESTS = """
requests AS (SELECT ts, event_id, 'POST' AS method, '/' || event_type AS path,
  value * 20 AS elapsed_ms FROM events)"""


def _ranked(percent: int) -> str:
    index = f"greatest(0, least(n - 1, round_even({percent} / 100 * n, 0)::INT))"
    return f"round(ms[{index} + 1], 2) AS p{percent}_ms"


_LATENCY = f"""
WITH {_REQUESTS},
recent AS (SELECT elapsed_ms FROM requests ORDER BY ts DESC, event_id DESC LIMIT 1000),
stats AS (SELECT list(elapsed_ms ORDER BY elapsed_ms) AS ms, count(*) AS n,
  avg(elapsed_ms) AS mean, max(elapsed_ms) AS peak,
  count(*) FILTER (elapsed_ms > 2000) AS over FROM recent)
SELECT n AS total_requests, {_ranked(50)}, {_ranked(95)}, {_ranked(99)},
  round(mean, 2) AS avg_ms, round(peak, 2) AS max_ms,
  round(over / n * 100, 2) AS sla_violation_pct, 2000.0::DOUBLE AS sla_threshold_ms FROM stats"""


def _windows(source: str, keys: str) -> str:
    """Metrics of ``source`` (whole ``elapsed_ms`` and the keys) by the keys, means half up."""
    return f"""
stats AS (SELECT {keys}, list(elapsed_ms ORDER BY elapsed_ms) AS ms, count(*) AS n,
  sum(elapsed_ms)::BIGINT AS total, max(elapsed_ms) AS peak,
  count(*) FILTER (elapsed_ms > 2000) AS over FROM {source} GROUP BY ALL)
SELECT {keys}, n AS total_requests, {_ranked(50)}, {_ranked(95)}, {_ranked(99)},
  ((total * 200 + n) // (2 * n)) / 100 AS avg_ms, round(peak, 2) AS max_ms,
  round(over / n * 100, 2) AS sla_violation_pct, 2000.0::DOUBLE AS sla_threshold_ms FROM stats"""


def _written(start: str) -> str:
    return f"strftime({start}, '%Y-%m-%d %H:%M') AS window_start"


_WHOLE = _REQUESTS.replace("value * 20 AS", "floor(value * 20) AS")
# Requests by the run that sees them; a window is closed an hour after its end, and requests
# for windows closed before their run are left out.
_CLOSED = f"""
WITH {_WHOLE},
arrived AS (SELECT *, least(2, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END
    + (event_id % 40 = 0)::INT) AS part,
  date_trunc('day', ts) + INTERVAL 6 HOUR * (hour(ts) // 6) AS w FROM requests),
marks AS (SELECT part, max(max(ts)) OVER (ORDER BY part) - INTERVAL 1 HOUR AS mark
  FROM arrived GROUP BY part),
closed AS (SELECT path, w, elapsed_ms FROM arrived LEFT JOIN marks ON marks.part = arrived.part - 1
  WHERE (mark IS NULL OR w + INTERVAL 6 HOUR > mark)
    AND w + INTERVAL 6 HOUR <= (SELECT max(mark) FROM marks)),"""
_BY_WINDOW = (
    _CLOSED
    + f"named AS (SELECT path, {_written('w')}, elapsed_ms FROM closed),"
    + _windows("named", "window_start, path")
)
_BY_DAY = (
    _CLOSED
    + f"named AS (SELECT path, {_written("date_trunc('day', w)")}, elapsed_ms FROM closed),"
    + _windows("named", "window_start, path")
)
_OVERLAPPING = f"""
WITH {_WHOLE},
halves AS (SELECT *, date_trunc('day', ts) + INTERVAL 12 HOUR * (hour(ts) // 12) AS w
  FROM requests),
named AS (SELECT path, {_written("w - INTERVAL 12 HOUR * k")}, elapsed_ms
  FROM halves, range(2) t(k)),
{_windows("named", "window_start, path")}"""
_NEWEST_METRICS = f"""
WITH {_WHOLE},
recent AS (SELECT path, elapsed_ms FROM requests
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) <= 1000),
{_windows("recent", "path")}"""
_BREACHES = f"""
WITH {_REQUESTS}
SELECT event_id, 'WARNING' AS level, 'SLA BREACH — ' || method || ' ' || path || ' took ' ||
  printf('%.1f', elapsed_ms) || ' ms (threshold: 1500.0 ms)' AS message
FROM requests WHERE elapsed_ms > 1500"""
_TIMING = """
SELECT count(*) AS num_documents, round(sum(value * 20), 2) AS total_ms,
  round(avg(value * 20), 2) AS avg_ms_per_doc, round(min(value * 20), 2) AS min_ms,
  round(max(value * 20), 2) AS max_ms,
  round(avg(round(greatest(0, (30000 - value * 20) / 30000 * 100), 1)), 1)
    AS avg_overhead_reduction_pct,
  (count(*) * 30)::DOUBLE AS manual_total_s,
  round((count(*) * 30000 - sum(value * 20)) / (count(*) * 30000) * 100, 1)
    AS overhead_reduction_pct
FROM events"""
_BATCH = """count(*) AS total_documents,
  count(*) FILTER (event_type <> 'error') AS successful,
  count(*) FILTER (event_type = 'error') AS failed"""
_BATCH_LATENCY = """round(coalesce(avg(round(value * 20, 2)) FILTER (event_type <> 'error'), 0), 2)
    AS avg_latency_ms,
  round(coalesce(max(round(value * 20, 2)) FILTER (event_type <> 'error'), 0), 2)
    AS max_latency_ms,
  round(count(*) FILTER (event_type <> 'error' AND round(value * 20, 2) < 2000)
    / count(*) * 100, 1) AS sub_2s_transactions_pct"""

# Files --------------------------------------------------------------------------------

_PATHS = """
paths AS (SELECT page_id, page_id % 7 AS e,
  '/in/d' || page_id % 10 || '/p' || page_id ||
    ['.jpg', '.PNG', '.mp4', '.pdf', '', '.tar.webp', '.zip'][page_id % 7 + 1] AS path
  FROM pages)"""


def _stored_fields(bills: str) -> str:
    return f"WITH {bills}, {_ALL_FIELDS} SELECT doc_id, doc_type, vendor, date, amount FROM extracted"


ORACLES: dict[str, str] = {
    "classify_keywords": f"WITH {_BILLS}, {_TYPED} SELECT * FROM typed",
    "classify_documents": f"""WITH {_CORPUS}, {_TYPED}
        SELECT doc_type, confidence, count(*) AS documents FROM typed GROUP BY ALL""",
    "extract_dates": f"""WITH {_BILLS}, {_DATES}
        SELECT doc_id, value AS invoice_date, coalesce(score, 0.0::DOUBLE) AS confidence
        FROM bills LEFT JOIN date_best USING (doc_id)""",
    "extract_amounts": f"""WITH {_BILLS}, {_AMOUNTS}
        SELECT doc_id, value AS amount, CASE WHEN value IS NOT NULL THEN 'USD' END AS currency,
          coalesce(score, 0.0::DOUBLE) AS confidence
        FROM bills LEFT JOIN amount_best USING (doc_id)""",
    "amount_candidates_plain": f"""WITH {_BILLS}, {_pieces('pieces', _PLAIN_AMOUNT)},
        {_matches('found', 'pieces', 40)},
        valued AS (SELECT doc_id, replace(ctx, 'subtotal', '--------') AS ctx,
          contains(ctx, 'subtotal') AS sub,
          regexp_replace(raw, '[^0-9.]', '', 'g')::DOUBLE AS value FROM found),
        scored AS (SELECT doc_id, value, CASE WHEN {_NEAR_TOTAL} THEN 9 WHEN sub THEN 3 ELSE 5 END
          AS score FROM valued WHERE value >= 0.01)
        SELECT doc_id, count(*) AS candidates, count(*) FILTER (score = 9) AS near_total,
          count(*) FILTER (score = 3) AS near_subtotal, max(value) AS largest
        FROM scored GROUP BY doc_id""",
    "extract_vendor_line": f"""WITH {_BILLS}, {_LINES}
        SELECT doc_id, line AS vendor,
          CASE WHEN line IS NULL THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END AS confidence
        FROM bills LEFT JOIN first_lines USING (doc_id)""",
    "vendor_dictionary": f"WITH {_CUSTOMER_BILLS}, {_MENTIONS} SELECT * FROM mentions",
    "summarize_documents": f"WITH {_CORPUS}, {_SUMMARY} SELECT * FROM summaries",
    "extract_bills": f"WITH {_CUSTOMER_BILLS}, {_ALL_FIELDS} SELECT * FROM extracted",
    "extract_corpus": f"WITH {_CORPUS}, {_ALL_FIELDS} SELECT * FROM extracted",
    "extract_with_vendor_table": f"""WITH {_CUSTOMER_BILLS}, {_ALL_FIELDS}, {_MENTIONS}
        SELECT doc_id, coalesce(m.vendor, e.vendor) AS vendor,
          CASE WHEN m.vendor IS NULL THEN vendor_conf ELSE 0.8::DOUBLE END AS vendor_conf,
          date, amount FROM extracted e LEFT JOIN mentions m USING (doc_id)""",
    "evaluate_fields": f"""{_COMPARED}, by_field AS ({_BY_FIELD}),
        ratios AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
          CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM by_field)
        SELECT field, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall,
          round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM ratios""",
    "evaluate_summary": f"""{_COMPARED}
        SELECT n AS total_documents, failed, types AS doc_type_correct,
          round(ms, 2) AS avg_preprocessing_ms,
          round((vendor_tp + date_tp + amount_tp) / (n * 3), 4) AS overall_accuracy,
          round(types / n, 4) AS doc_type_accuracy,
          (vendor_tp + date_tp + amount_tp) / (n * 3) >= 0.95 AS target_met FROM counted""",
    "evaluate_details": f"""{_COMPARED}
        SELECT file_path, success, vendor_match, date_match, amount_match, doc_type_match,
          pred_vendor, pred_date, pred_amount FROM compared""",
    "evaluate_skipped": f"""WITH {_LABELS}
        SELECT k::VARCHAR AS doc_id, file_path FROM truth WHERE file_path = 'missing.jpg'""",
    "reading_order": f"""WITH {_TOKENS}, {_READ}
        SELECT doc_id, page, 'easyocr' AS engine, tokens, md5(full_text) AS text_md5 FROM read""",
    "engine_fallback_tokens": f"""WITH {_TOKENS}, {_TWO_ENGINES}
        SELECT doc_id, page, engine, count(*) AS tokens FROM chosen GROUP BY ALL""",
    "page_assembly": f"WITH {_TOKENS}, {_READ} " + _documents("read", "'easyocr'"),
    "documents_with_fallback": f"WITH {_TOKENS}, {_TWO_ENGINES} "
    + _documents("page_texts", "arg_min(engine, page)"),
    "page_cap": """SELECT conv_id, count(*) AS pages, sum(length(text))::BIGINT AS chars
        FROM conversations WHERE turn < 5 GROUP BY conv_id""",
    "token_filter_boxes": """SELECT l_orderkey, l_linenumber, l_returnflag AS text,
          round(l_discount * 20 / 100, 6) AS confidence, (l_linenumber + 30)::BIGINT AS right,
          (l_quantity::INT + 10)::BIGINT AS bottom
        FROM lineitem WHERE l_discount * 20 >= 1 AND l_returnflag <> 'N'""",
    "xml_image_boxes": _XML_BOXES,
    "xml_image_shapes": _XML_SHAPES,
    "xml_track_boxes": f"""
        SELECT 'frame_' || p_size AS image_path, lower(p_type) AS label, 'cvat' AS source_tool,
          {_box('1', '2', '3', '4')}, p_size::VARCHAR AS frame, 'manual' AS source FROM part
        UNION ALL
        SELECT 'frame_0', lower(p_type), 'cvat', {_box('p_size', '0', '9', '9')}, '0', 'manual'
        FROM part""",
    "task_json_records": _JSON_RECORDS,
    "box_text_records": f"""SELECT 'img' || l_orderkey AS image_path, {_CLASS} AS label,
          'roboflow' AS source_tool, l_linenumber::VARCHAR AS class_id, 'true' AS normalised,
          count(*) AS boxes, min(round(l_quantity / 100 - 0.125, 6)) AS x_min,
          max(round(l_quantity / 100 + 0.125, 6)) AS x_max, 0.4375::DOUBLE AS y_min,
          0.5625::DOUBLE AS y_max FROM {_GOOD_LINES} GROUP BY ALL""",
    "box_text_with_sizes": f"""SELECT image_path, count(*) AS boxes,
          round(max(w * 0.25::DOUBLE), 6) AS width, round(max(h * 0.125::DOUBLE), 6) AS height,
          'false' AS normalised
        FROM (SELECT CASE
            WHEN l_orderkey % 4 = 0 THEN '/images/img' || l_orderkey || '.jpg'
            WHEN l_orderkey % 2 = 0 THEN '/images/img' || l_orderkey || '.bmp'
            ELSE 'img' || l_orderkey END AS image_path,
          CASE WHEN l_orderkey % 4 = 0 THEN 200 WHEN l_orderkey % 2 = 0 THEN 640 ELSE 1 END AS w,
          CASE WHEN l_orderkey % 2 = 0 THEN 100 ELSE 1 END AS h FROM {_GOOD_LINES})
        GROUP BY image_path""",
    "class_lookup": """SELECT l_linenumber AS class_id,
          coalesce(n_name, 'class_' || l_linenumber) AS label, count(*) AS boxes
        FROM lineitem LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0)
          ON l_linenumber = n_nationkey GROUP BY ALL""",
    "xml_files": _XML_FILES,
    "xml_rejects": _XML_REJECTS,
    "task_json_files": _JSON_FILES,
    "task_json_rejects": _JSON_REJECTS,
    "box_text_files": f"""
        WITH lines AS (SELECT *, ['_img', '.img', 'img'][l_suppkey % 3 + 1] || l_suppkey AS stem
          FROM lineitem)
        SELECT stem AS image_path, {_CLASS} AS label, count(*) AS boxes,
          round(max(l_quantity / 100 + 0.125), 6) AS x_max
        FROM lines WHERE l_orderkey % 23 <> 0 GROUP BY ALL
        UNION ALL
        SELECT stem, 'rejected', count(*), NULL FROM lines WHERE l_orderkey % 23 = 0 GROUP BY ALL""",
    "directory_files": """
        WITH files AS (SELECT page_id AS k, page_id % 7 AS e, md5(coalesce(html, '')) AS content_md5,
          'd' || page_id % 10 || '/' || CASE WHEN page_id % 4 = 0 THEN '_' ELSE 'p' END || page_id ||
            ['.jpg', '.PNG', '.mp4', '.pdf', '', '.tar.webp', '.zip'][page_id % 7 + 1] AS name
          FROM pages),
        videos AS (SELECT *, CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN k % 5 * 3 END AS total
          FROM files WHERE e = 2)
        SELECT name AS source_path, -1::BIGINT AS frame_idx, content_md5, NULL AS error
        FROM files WHERE e IN (0, 1, 5)
        UNION ALL
        SELECT name || '::frame_' || i, i * greatest(1, total // 5), NULL, NULL
        FROM videos, range(5) t(i) WHERE i * greatest(1, total // 5) < total
        UNION ALL
        SELECT name, -1, NULL, CASE WHEN total IS NULL THEN 'no_frame_count' ELSE 'no_frames' END
        FROM videos WHERE coalesce(total, 0) = 0""",
    "zip_files": """
        WITH members AS (SELECT doc_id // 100 AS n, text,
          'p' || doc_id % 3 || '/' || doc_id || '.png' AS member FROM documents)
        SELECT 'batch_' || n || '.zip' AS archive,
          (row_number() OVER (PARTITION BY n ORDER BY member) - 1)::INT AS member_index, member,
          md5(text) AS content_md5, false AS broken FROM members WHERE n % 5 <> 4
        UNION ALL
        SELECT DISTINCT 'batch_' || n || '.zip', NULL, NULL, NULL, true FROM members WHERE n % 5 = 4""",
    "step_timings": """
        SELECT 'first' AS step, count(*) AS runs, true AS measured FROM part
        UNION ALL
        SELECT 'second', count(*), true FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0""",
    "merged_annotations": f"""
        SELECT source_tool, label, count(*) AS records, count(x_min) AS boxes FROM (
          SELECT source_tool, label, x_min FROM ({_XML_BOXES})
          UNION ALL SELECT source_tool, label, x_min FROM ({_JSON_RECORDS})
          UNION ALL SELECT 'roboflow', {_CLASS}, 1.0 FROM {_GOOD_LINES}) GROUP BY ALL""",
    "latency_report": _LATENCY,
    "newest_per_path": f"""WITH {_REQUESTS}
        SELECT path, event_id, round(elapsed_ms, 4) AS elapsed_ms FROM requests
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) <= 20""",
    "sla_breaches": _BREACHES,
    "request_lines": f"""WITH {_REQUESTS}
        SELECT event_id, printf('%.2f', elapsed_ms) AS header,
          CASE WHEN elapsed_ms > 2000 THEN 'WARNING' ELSE 'INFO' END AS level FROM requests""",
    "batch_summary": f"""SELECT {_BATCH},
          round(epoch(max(ts)) - epoch(min(ts)), 3) AS total_elapsed_sec,
          round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 2) AS throughput_docs_per_sec,
          {_BATCH_LATENCY}, NULL::VARCHAR AS error FROM events""",
    "batch_summary_by_user": f"SELECT user_id, {_BATCH}, {_BATCH_LATENCY} FROM events GROUP BY user_id",
    "overhead_stats": _TIMING,
    "overhead_per_request": """SELECT
          round(greatest(0, (30000 - value * 2000) / 30000 * 100), 1) AS saved_pct,
          count(*) AS requests FROM events GROUP BY ALL""",
    "keyframes_of_media": """SELECT 'part_' || p_partkey AS media_id, k::INT AS sample_no,
          (k * step)::BIGINT AS frame_idx, 'part_' || p_partkey || '::frame_' || k AS source_path
        FROM (SELECT p_partkey, p_size, greatest(1, p_size // 10) AS step,
                unnest(range(0, 10)) AS k FROM part) WHERE k * step < p_size""",
    "keyframes_of_turns": """SELECT conv_id, turn, (turn // step)::INT AS sample_no FROM (
          SELECT *, greatest(1, count(*) OVER (PARTITION BY conv_id) // 3) AS step
          FROM conversations) WHERE turn % step = 0 AND turn // step < 3""",
    "keyframes_of_events": """SELECT event_type, position, (position // step)::INT AS sample_no,
          event_id FROM (
          SELECT event_type, event_id,
            row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS position,
            greatest(1, count(*) OVER (PARTITION BY event_type) // 50) AS step FROM events)
        WHERE position % step = 0 AND position // step < 50""",
    "scan_discovery": f"""WITH {_PATHS}
        SELECT page_id, CASE WHEN e = 2 THEN 'video' ELSE 'image' END AS kind,
          '/in/d' || page_id % 10 AS directory, string_split(path, '/')[-1] AS name
        FROM paths WHERE e IN (0, 1, 2, 5)""",
    "media_routing": """SELECT page_id,
          CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'image'
               WHEN page_id % 7 = 3 THEN 'pdf' ELSE 'image' END AS kind FROM pages""",
    "upload_guards": """SELECT page_id, CASE
          WHEN page_id % 7 <> 6 THEN 'not_zip'
          WHEN page_id % 14 = 6 THEN 'empty' ELSE 'accepted' END AS reason
        FROM pages""",
    "zip_expand": """SELECT 'doc_' || doc_id || '.zip' AS archive, i::BIGINT AS member_index,
          ['b.png', 'sub/a.JPG'][i + 1] AS member,
          md5(['b.png', 'sub/a.JPG'][i + 1] || '|' || text) AS content_md5, false AS broken
        FROM documents, (SELECT unnest([0, 1]) AS i) WHERE doc_id % 50 <> 0
        UNION ALL
        SELECT 'doc_' || doc_id || '.zip', NULL, NULL, NULL, true
        FROM documents WHERE doc_id % 50 = 0""",
    "guarded_map": """SELECT doc_id, n_chars % 10 <> 0 AS success,
          CASE WHEN n_chars % 10 = 0 THEN 'unreadable page' END AS error,
          CASE WHEN n_chars % 10 <> 0 THEN length(text) - length(replace(text, 'e', '')) END
            AS letters FROM documents""",
    "labels_from_csv": """SELECT o_orderkey::VARCHAR AS doc_id,
          'bill_' || o_orderkey || '.jpg' AS file_path, NULL::VARCHAR AS vendor_name,
          CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate::DATE END AS invoice_date,
          CASE WHEN o_orderkey % 15 <> 0 AND o_orderkey % 4 <> 0 THEN o_orderkey::DOUBLE END
            AS total_amount,
          CASE WHEN o_orderkey % 30 = 0 THEN 'invoice_date,total_amount'
               WHEN o_orderkey % 6 = 0 THEN 'invoice_date'
               WHEN o_orderkey % 15 = 0 THEN 'total_amount' ELSE '' END AS malformed
        FROM orders""",
    "engine_pages": """SELECT p_partkey::BIGINT + 9007199254740992 AS doc_id,
          CASE WHEN second THEN 'tesseract_fallback' ELSE 'easyocr' END AS engine,
          len(string_split(p_type, ' '))::BIGINT AS tokens,
          md5(CASE WHEN second THEN lower(p_type) ELSE p_type END) AS text_md5
        FROM (SELECT *, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS second FROM part)""",
    "document_names": """SELECT page_id, source_path, sha256(source_path) AS doc_id FROM (
          SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url ELSE 'image_' || page_id END
            AS source_path FROM pages)""",
    "artifact_sink": _stored_fields(_BILLS),
    "report_sink": _TIMING,
    "stream_extract": _stored_fields(_BILLS),
    "stream_vendor_table": f"""WITH {_BILLS}, {_ALL_FIELDS},
        known AS (SELECT o_orderkey AS doc_id, 'Trading House ' || o_custkey AS name FROM orders
          WHERE o_orderkey % 11 <> 0 AND o_custkey % 2 = 0
            AND o_custkey IN (SELECT c_custkey FROM customer))
        SELECT doc_id, coalesce(name, vendor) AS vendor,
          CASE WHEN name IS NULL THEN vendor_conf ELSE 0.8::DOUBLE END AS vendor_conf, date, amount
        FROM extracted LEFT JOIN known USING (doc_id)""",
    "stream_metrics": _LATENCY,
    "stream_windows": _BY_WINDOW,
    "stream_windows_by_day": _BY_DAY,
    "latency_by_window": _OVERLAPPING,
    "stream_artifacts": f"""
        WITH kept AS (SELECT * FROM conversations WHERE conv_id % 3 <> 0 OR turn < 2),
        bills AS (SELECT conv_id::VARCHAR AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text,
          count(*) AS pages, sum(len(string_split(text, ' ')))::BIGINT AS tokens
          FROM kept GROUP BY conv_id), {_TYPED}
        SELECT doc_id, doc_type, pages, tokens FROM typed JOIN bills USING (doc_id)""",
    "evaluation_sink": f"""{_COMPARED}, by_field AS ({_BY_FIELD}),
        ratios AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
          CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM by_field),
        scored_fields AS (SELECT field, round(p, 4) AS precision,
          round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM ratios)
        SELECT n AS total_documents, round((vendor_tp + date_tp + amount_tp) / (n * 3), 4)
            AS overall_accuracy,
          (SELECT precision FROM scored_fields WHERE field = 'vendor') AS vendor_precision,
          (SELECT f1 FROM scored_fields WHERE field = 'amount') AS amount_f1,
          (vendor_tp + date_tp + amount_tp) / (n * 3) >= 0.95 AS target_met,
          round(ms, 2) AS avg_ms_per_doc, n AS rows, n AS listed, true AS counted,
          vendor_tp AS vendor_matches, (SELECT min(file_path) FROM compared) AS first_file,
          (SELECT max(file_path) FROM compared) AS last_file FROM counted""",
    "stream_newest_per_path": f"""WITH {_WHOLE}
        SELECT path, event_id, elapsed_ms FROM requests
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) <= 100""",
    "stream_metrics_per_path": _NEWEST_METRICS,
    "stream_breaches": _BREACHES,
    "stream_batches": """SELECT 'doc_' || doc_id || '.zip' AS archive,
          CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 2 END::BIGINT AS total_documents,
          CASE WHEN doc_id % 50 = 0 THEN 0 ELSE ((length(text) + 6) % 7 <> 0)::INT
            + ((length(text) + 10) % 7 <> 0)::INT END::BIGINT AS successful,
          CASE WHEN doc_id % 50 = 0 THEN 0 ELSE ((length(text) + 6) % 7 = 0)::INT
            + ((length(text) + 10) % 7 = 0)::INT END::BIGINT AS failed,
          doc_id % 50 = 0 AS broken
        FROM documents""",
}
