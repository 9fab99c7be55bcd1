"""Queries of the document engine over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import layout as L
from docloom.functions import markdown as M
from docloom.functions import text as T
from docloom.operators import convert, fold, html, parts
from docloom.operators import layout as layout_ops
from docloom.session import shared_dir, ship
from docloom.sources import scans, sinks

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"


def quoted(x: str) -> str:
    return x.replace("'", "''")


def text_sql(x: str) -> str:
    return f"replace(replace(replace(replace(regexp_replace({x}, '&([a-zA-Z#0-9]+;)', chr(1) || '\\1', 'g'), '&', '&amp;'), chr(1), '&'), '<', '&lt;'), '>', '&gt;')"


def inline_sql(x: str) -> str:
    s = text_sql(f"trim({x})")
    for a, b in (("`([^`]+)`", "<code>\\1</code>"), ("\\*\\*([^*]+)\\*\\*", "<strong>\\1</strong>"), ("(^|[\\s(])\\*([^*\\s][^*]*)\\*", "\\1<em>\\2</em>"), ("(^|[\\s(])_([^_\\s][^_]*)_", "\\1<em>\\2</em>"), ("\\[([^\\]]+)\\]\\((https?://[^\\s)]+)\\)", '<a href="\\2">\\1</a>')):
        s = f"regexp_replace({s}, '{a}', '{b}', 'g')"
    return s


LINE_SQL = "SELECT doc_id, pos - 1 AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(f"""
WITH piece AS (SELECT doc_id, pos, trim(line) AS p FROM ({LINE_SQL}) WHERE trim(line) <> ''),
block AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, CASE WHEN starts_with(p, '# ') THEN 'h1' ELSE 'p' END AS tag, CASE WHEN starts_with(p, '# ') THEN substr(p, 3) ELSE p END AS p FROM piece),
body AS (SELECT doc_id, count(*) AS n, string_agg('<' || tag || ' id="block-' || k || '">' || {esc('p')} || '</' || tag || '>' || chr(10), '' ORDER BY k) AS body FROM block GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n_blocks, '{sinks.HEAD}' || 'Document ' || doc_id || '{quoted(sinks.STYLE)}' || coalesce(body, '') || '{sinks.FOOT}' AS html FROM documents LEFT JOIN body USING (doc_id)""")
def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text to numbered blocks to standalone pages, native all through and without a shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", scans.paragraphs(F.col("text"), "\n").alias("raw"))
    named = F.transform("raw", lambda b, i: F.struct(F.concat(F.lit("block-"), (i + 1).cast("string")).alias("id"), T.with_root_id(b, F.concat(F.lit("block-"), (i + 1).cast("string"))).alias("html")))
    blocks = docs.select("doc_id", named.alias("blocks"))
    return blocks.select("doc_id", F.size("blocks").alias("n_blocks"), sinks.document_html(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.col("blocks")).alias("html"))


@query(f"""SELECT doc_id, CAST(pos AS INT) AS pos, {esc('line')} AS escaped, {inline_sql('line')} AS inline,
CASE WHEN trim(regexp_replace(line, '\\s+', ' ', 'g')) = '' THEN '' ELSE '<p>' || replace(replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '<', '&lt;'), '>', '&gt;') || '</p>' END AS paragraph,
line AS unfenced, regexp_matches(line, '^[A-Za-z][A-Za-z0-9_-]*$') AS is_id FROM ({LINE_SQL})""")
def line_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar text functions on every line."""
    line = F.col("line")
    fenced = F.concat(F.lit("```html\n"), line, F.lit("\n```\n"))
    same = F.when(T.trim(line) == T.trim(T.strip_fence(fenced)), line).otherwise(F.lit(None))
    return lines(spark, sf_dir).select("doc_id", "pos", T.escape_html(line).alias("escaped"), T.inline(line).alias("inline"), T.text_paragraph(line).alias("paragraph"), same.alias("unfenced"), T.is_block_id(line).alias("is_id"))


EXT_SQL = "CASE lower(regexp_extract(url, '\\.([^.]*)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.MEDIA_TYPES.items()) + " END"


@query(f"""SELECT page_id, {EXT_SQL} AS media_type, coalesce(nullif(substr(trim(regexp_replace(url, '\\.[A-Za-z0-9]{{1,5}}$', '')), 1, 200), ''), 'document') AS title,
coalesce(nullif(substr(regexp_replace(trim(regexp_replace(url, '[^A-Za-z0-9 _.-]+', '', 'g')), ' +', '-', 'g'), 1, 80), ''), 'document') AS slug,
starts_with(lower(trim(url)), 'http://') OR starts_with(lower(trim(url)), 'https://') AS safe,
url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'unit=page&index=2&total=3' AS part_url FROM pages""")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media types, titles, download names and link safety of addresses."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.media_type(u).alias("media_type"), T.title_of(u).alias("title"), T.slug_of(u).alias("slug"), T.is_safe_url(u).alias("safe"), scans.part_url(u, F.lit("page"), F.lit(2), F.lit(3)).alias("part_url"))


@query("SELECT doc_id, md5('data:text/plain;base64,' || base64(encode(text))) AS data_url, octet_length(encode(text)) AS n_bytes, FALSE AS pdf, 'text/plain' AS media_type FROM documents")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as typed sources: bytes, data URLs, and the PDF sniff."""
    rows = table(spark, sf_dir, "documents").select("doc_id", scans.plain(F.col("text")).alias("s"))
    return rows.select("doc_id", F.md5(T.data_url(F.col("s.media_type"), F.col("s.content")).cast("binary")).alias("data_url"), F.octet_length("s.content").cast("long").alias("n_bytes"), T.looks_like_pdf(F.col("s.content")).alias("pdf"), F.col("s.media_type").alias("media_type"))


def div_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a layout model would send them; every 7th has an unknown label, every 5th a bad box."""
    label = F.get(F.array(*map(F.lit, L.LABELS)), F.col("pos") % 11)
    label = F.when(F.col("pos") % 7 == 6, "Nonsense").when(F.col("pos") % 3 == 1, F.replace(F.lower(label), F.lit("-"), F.lit("_"))).otherwise(label)
    y, x = F.col("pos") * 37 % 900, F.col("pos") * 53 % 900
    box = F.when(F.col("pos") % 5 == 4, F.concat_ws(",", y, x, y)).otherwise(F.concat(F.lit("["), F.concat_ws(", ", y, x, y + 50, (x + 80).cast("string")), F.lit(".5]")))
    return lines(spark, sf_dir).withColumn("div", F.concat(F.lit('<div data-bbox="'), box, F.lit('" data-label="'), label, F.lit('" data-page="'), (F.col("pos") % 4).cast("string"), F.lit('">'), F.col("line"), F.lit("</div>")))


ELEMENT_SQL = f"""SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN pos % 7 = 6 THEN 'Text' ELSE [{", ".join(f"'{x}'" for x in L.LABELS)}][pos % 11 + 1] END AS label,
CASE WHEN pos % 5 = 4 THEN NULL ELSE (pos * 37 % 900) || ',' || (pos * 53 % 900) || ',' || (pos * 37 % 900 + 50) || ',' || (pos * 53 % 900 + 81) END AS bbox,
CASE WHEN pos % 4 > 0 THEN CAST(pos % 4 AS INT) END AS page, trim(line) AS content FROM ({LINE_SQL})"""


@query(ELEMENT_SQL)
def layout_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divs decoded to typed elements."""
    e = div_rows(spark, sf_dir).select("doc_id", "pos", L.decode_div(F.col("div")).alias("e"))
    return e.select("doc_id", "pos", "e.label", F.array_join(F.col("e.bbox").cast("array<string>"), ",").alias("bbox"), "e.page", "e.content")


ATTRS_SQL = "coalesce(' data-page=\"' || page || '\"', '') || coalesce(' data-bbox=\"' || bbox || '\"', '')"
RENDER_SQL = f"""CASE WHEN content = '' OR label IN ('Page-header', 'Page-footer') THEN ''
WHEN label = 'Title' THEN '<h1' || attrs || '>' || {inline_sql("regexp_replace(content, '^\\s*#{1,6}\\s*', '')")} || '</h1>'
WHEN label = 'Section-header' THEN '<h2' || attrs || '>' || {inline_sql("regexp_replace(content, '^\\s*#{1,6}\\s*', '')")} || '</h2>'
WHEN label = 'Picture' THEN '<figure' || attrs || '><figcaption>' || {inline_sql("regexp_replace(content, '[\\[\\]]', '', 'g')")} || '</figcaption></figure>'
WHEN label = 'Formula' THEN '<pre' || attrs || '><code>' || {text_sql("regexp_replace(regexp_replace(content, '^\\$\\$\\s*', ''), '\\s*\\$\\$$', '')")} || '</code></pre>'
WHEN label = 'List-item' THEN '<li' || attrs || '>' || {inline_sql("regexp_replace(content, '^\\s*(?:[-*+]|[0-9]+[.)])\\s+', '')")} || '</li>'
ELSE '<p' || attrs || '>' || {inline_sql("content")} || '</p>' END"""


@query(f"""
WITH e AS (SELECT *, {ATTRS_SQL} AS attrs FROM ({ELEMENT_SQL})), shown AS (SELECT doc_id, pos, label, {RENDER_SQL} AS html FROM e),
run AS (SELECT *, sum(CASE WHEN label = 'List-item' AND before = 'List-item' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island
  FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM shown WHERE html <> '')),
joined AS (SELECT doc_id, min(pos) AS pos, min(label) AS label, string_agg(html, '' ORDER BY pos) AS html FROM run GROUP BY doc_id, island)
SELECT doc_id, pos, CASE WHEN label = 'List-item' THEN '<ul>' || html || '</ul>' ELSE html END AS html FROM joined""")
def layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements rendered; runs of list items joined over empty elements."""
    return layout_ops.to_html(div_rows(spark, sf_dir).select("doc_id", "pos", L.decode_div(F.col("div")).alias("element")))


MD_SQL = f"SELECT doc_id, CAST(pos AS INT) AS pos, trim(line) AS line FROM ({LINE_SQL}) WHERE trim(line) <> ''"


@query(f"""SELECT doc_id, pos, CASE pos % 5 WHEN 0 THEN '<h1>' || {inline_sql('line')} || '</h1>' WHEN 1 THEN '<ul><li>' || {inline_sql('line')} || '</li></ul>' WHEN 2 THEN '<ol><li>' || {inline_sql('line')} || '</li></ol>'
WHEN 3 THEN '<blockquote><p>' || {inline_sql('line')} || '</p></blockquote>' ELSE '<table><thead><tr><th scope="col">head</th><th scope="col">line</th></tr></thead><tbody><tr><td>' || pos || '</td><td>' || {inline_sql("replace(line, '|', '/')")} || '</td></tr></tbody></table>' END AS html FROM ({MD_SQL})""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as markdown of five shapes, rendered."""
    line = T.trim(F.col("line"))
    shapes = [F.concat(F.lit(x), line) for x in ("# ", "- ", "1. ", "> ")]
    grid = F.concat(F.lit("head | line\n--- | ---\n"), F.col("pos").cast("string"), F.lit(" | "), F.replace(line, F.lit("|"), F.lit("/")))
    block = grid
    for k, x in enumerate(shapes):
        block = F.when(F.col("pos") % 5 == k, x).otherwise(block)
    return lines(spark, sf_dir).filter(line != "").select("doc_id", "pos", M.block_html(block).alias("html"))


def event_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as fold inputs, one document per user; ids repeat, and a few end in errors or done."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(i % 97 == 0, "error").when(i % 89 == 0, "done").when(F.col("event_type") == "signup", "append").when(F.col("event_type").isin("click", "purchase"), "replace").otherwise("progress")
    ident = F.concat(F.lit("b"), (i % 31).cast("string"))
    return e.select(F.col("user_id").cast("string").alias("doc_id"), i.alias("pos"), kind.alias("type"), ident.alias("id"), F.concat(F.lit('<p id="'), ident, F.lit('">'), i.cast("string"), F.lit("</p>")).alias("html"), F.concat("event_type", F.lit(" "), i.cast("string")).alias("phase"), F.concat(F.lit("failed & stopped at "), i.cast("string")).alias("message"))


INPUT_SQL = """SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id AS pos, CASE WHEN event_id % 97 = 0 THEN 'error' WHEN event_id % 89 = 0 THEN 'done' WHEN event_type = 'signup' THEN 'append' WHEN event_type IN ('click', 'purchase') THEN 'replace' ELSE 'progress' END AS type,
'b' || (event_id % 31) AS id, '<p id="b' || (event_id % 31) || '">' || event_id || '</p>' AS html, event_type || ' ' || event_id AS phase, 'failed & stopped at ' || event_id AS message FROM events"""
NUMBER_SQL = f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM (SELECT *, min(CASE WHEN type IN ('done', 'error') THEN pos END) OVER (PARTITION BY doc_id) AS stop FROM ({INPUT_SQL})) WHERE stop IS NULL OR pos <= stop"""
LOG_SQL = f"""SELECT doc_id, 1 AS version, seq, type, CASE WHEN type = 'append' THEN id END AS block_id, CASE WHEN type = 'replace' THEN '#' || id END AS target, CASE WHEN type IN ('append', 'replace') THEN html END AS html,
CASE WHEN type = 'progress' THEN phase END AS phase, CASE WHEN type = 'error' THEN message END AS message FROM ({NUMBER_SQL})"""


@query(LOG_SQL)
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs to the numbered, gap-free log."""
    return fold.live_events(event_inputs(spark, sf_dir))


STATE_SQL = f"""
n AS ({NUMBER_SQL}),
block AS (SELECT a.doc_id, a.seq, a.id, coalesce((SELECT arg_max(r.html, r.seq) FROM n r WHERE r.doc_id = a.doc_id AND r.id = a.id AND r.type = 'replace' AND r.seq > a.seq), a.html) AS html FROM n a WHERE a.type = 'append'),
shown AS (SELECT doc_id, count(*) AS n, string_agg(id || '=' || html, chr(10) ORDER BY seq) AS blocks FROM block GROUP BY doc_id),
doc AS (SELECT doc_id, max(seq) AS seq, max(CASE WHEN type IN ('done', 'error') THEN type END) AS stop, arg_max(phase, seq) FILTER (type = 'progress') AS phase, max(message) FILTER (type = 'error') AS message FROM n GROUP BY doc_id),
state AS (SELECT doc_id, seq, coalesce(stop, 'running') AS status, CASE stop WHEN 'done' THEN 'Done' WHEN 'error' THEN 'Failed' ELSE coalesce(phase, 'Starting') END AS phase,
CASE WHEN stop = 'error' THEN coalesce(blocks || chr(10), '') || 'error=<p id="error" class="error" role="alert">' || {esc('message')} || '</p>' WHEN stop IS NULL AND blocks IS NULL THEN 'loading={fold.LOADING_HTML}' ELSE coalesce(blocks, '') END AS blocks FROM doc LEFT JOIN shown USING (doc_id))"""


@query(f"WITH {STATE_SQL} SELECT * FROM state")
def event_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs folded to snapshots."""
    flat = F.array_join(F.transform("blocks", lambda b: F.concat(b.id, F.lit("="), b.html)), "\n")
    return fold.fold(event_inputs(spark, sf_dir)).withColumn("blocks", flat)


@query(f"SELECT doc_id, seq, type FROM ({LOG_SQL}) WHERE seq > 3")
def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader who saw three events still needs."""
    return fold.replay(fold.live_events(event_inputs(spark, sf_dir)), 3).select("doc_id", "seq", "type")


@query(f"""SELECT doc_id, seq, 'id: ' || seq || chr(10) || 'event: ' || type || chr(10) || 'data: {{"version":1,"seq":' || seq || ',"type":"' || type || '"' || coalesce(',"block_id":"' || block_id || '"', '') || coalesce(',"target":"' || target || '"', '')
|| coalesce(',"html":"' || replace(html, '"', '\\"') || '"', '') || coalesce(',"phase":"' || phase || '"', '') || coalesce(',"message":"' || message || '"', '') || '}}' || chr(10) || chr(10) AS frame FROM ({LOG_SQL})
UNION ALL SELECT DISTINCT doc_id, 0 AS seq, 'retry: 2000' || chr(10) || chr(10) AS frame FROM ({LOG_SQL})""")
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs as server-sent events."""
    return sinks.sse_stream(fold.live_events(event_inputs(spark, sf_dir)))


@query(f"""WITH {STATE_SQL}, piece AS (SELECT doc_id, status, unnest(string_split(blocks, chr(10))) AS b, unnest(generate_series(1, len(string_split(blocks, chr(10))))) AS k FROM state WHERE status <> 'running' AND blocks <> '')
SELECT doc_id, CAST(k AS BIGINT) AS seq, 'append' AS type, regexp_extract(b, '^([^=]*)=', 1) AS block_id, NULL AS message FROM piece
UNION ALL SELECT s.doc_id, CAST(coalesce(m, 0) + 1 AS BIGINT), status, NULL, CASE WHEN status = 'error' THEN 'The conversion failed.' END FROM state s LEFT JOIN (SELECT doc_id, max(k) AS m FROM piece GROUP BY doc_id) USING (doc_id) WHERE status <> 'running'""")
def event_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored snapshots as the logs that they replay as."""
    state = fold.fold(event_inputs(spark, sf_dir)).filter("status <> 'running'")
    return fold.restore(state).select("doc_id", "seq", "type", "block_id", "message")


def contract_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of which some are about the blocks ``loading`` and ``error``, or are no single element."""
    e, i = event_inputs(spark, sf_dir), F.col("pos")
    ident = F.when(i % 11 == 3, "loading").when(i % 11 == 4, "error").otherwise(F.col("id"))
    end = F.when(i % 13 == 5, F.lit("</div>")).otherwise(F.lit("</p>"))
    return e.withColumn("id", ident).withColumn("html", F.concat(F.lit('<p id="'), F.col("id"), F.lit('">'), i.cast("string"), end))


JUDGED_SQL = f"""
c AS (SELECT doc_id, pos, type, CASE WHEN pos % 11 = 3 THEN 'loading' WHEN pos % 11 = 4 THEN 'error' ELSE id END AS id, pos % 13 <> 5 AS single, phase, message FROM ({INPUT_SQL})),
d AS (SELECT *, (SELECT arg_min(t.type, t.pos) FROM c t WHERE t.doc_id = c.doc_id AND t.pos < c.pos AND t.type IN ('done', 'error')) AS stop FROM c),
b AS (SELECT d.*, coalesce((SELECT arg_max(a.id, a.pos) FROM d a WHERE a.doc_id = d.doc_id AND a.pos < d.pos AND a.type = 'append' AND a.single AND a.stop IS NULL), 'loading') AS latest,
  EXISTS (SELECT 1 FROM d a WHERE a.doc_id = d.doc_id AND a.id = d.id AND a.pos < d.pos AND a.type = 'append' AND a.single AND a.stop IS NULL) AS added FROM d),
k AS (SELECT *, CASE WHEN id = 'loading' THEN stop IS NULL AND latest = 'loading' ELSE added OR (id = 'error' AND coalesce(stop = 'error', FALSE)) END AS known FROM b),
judged AS (SELECT *, CASE WHEN type NOT IN ('append', 'replace') THEN NULL WHEN NOT single THEN type || ' #' || id || ' must be one complete element whose root id is ' || id
  WHEN type = 'append' AND known THEN 'duplicate block id #' || id WHEN type = 'replace' AND NOT known THEN 'replace target #' || id || ' does not exist' END AS violation FROM k)"""


@query(f"WITH {JUDGED_SQL} SELECT doc_id, pos, violation FROM judged WHERE violation IS NOT NULL")
def event_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that break the contract."""
    return fold.violations(contract_inputs(spark, sf_dir))


@query(f"""WITH {JUDGED_SQL}, bad AS (SELECT doc_id, min(pos) AS first FROM judged WHERE violation IS NOT NULL GROUP BY doc_id)
SELECT doc_id, pos, CASE WHEN violation IS NULL THEN type ELSE 'error' END AS type, CASE WHEN violation IS NULL THEN id END AS id, coalesce(violation, message) AS message
FROM judged LEFT JOIN bad USING (doc_id) WHERE first IS NULL OR pos <= first""")
def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs up to the first that breaks the contract, which ends the document."""
    return fold.step(contract_inputs(spark, sf_dir)).select("doc_id", "pos", "type", "id", "message")


@query(f"""SELECT doc_id, seq, before FROM (SELECT doc_id, seq, lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS before FROM ({LOG_SQL}) WHERE seq % 5 <> 2 AND seq % 7 <> 1) WHERE seq <> coalesce(before, 0) + 1""")
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a log that lost some events."""
    return fold.gaps(fold.live_events(event_inputs(spark, sf_dir)).filter("seq % 5 <> 2 and seq % 7 <> 1"))


@query(f"""WITH {STATE_SQL}, s AS (SELECT doc_id, status, seq AS created_at FROM state)
SELECT doc_id, status, created_at FROM s WHERE doc_id <> coalesce((SELECT doc_id FROM s WHERE status <> 'running' ORDER BY created_at, doc_id LIMIT 1), '')""")
def session_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that stay when one must go."""
    return fold.evict(fold.fold(event_inputs(spark, sf_dir)).select("doc_id", "status", F.col("seq").alias("created_at")), 50)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN 0 ELSE event_id + 1 END AS after FROM events""")
def resume_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers' places from either field."""
    i = F.col("event_id")
    header = F.when(i % 3 == 0, i.cast("string")).when(i % 3 == 1, F.concat(i.cast("string"), F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", fold.resume_token(header, (i + 1).cast("string")).alias("after"))


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.lit("page").alias("unit"), (F.col("page_id") % 6).cast("int").alias("count"), "url")


@query("""SELECT CAST(page_id AS VARCHAR) AS doc_id, CASE WHEN page_id % 6 > 4 THEN 'error' WHEN page_id % 6 > 1 THEN 'split' ELSE 'whole' END AS path, CASE WHEN page_id % 6 > 4 THEN 'The document has ' || (page_id % 6) || ' pages; the limit is 4.' END AS message FROM pages""")
def part_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are split, read whole, or refused."""
    rows = paged(spark, sf_dir).withColumn("media_type", F.lit("application/pdf")).withColumn("split_error", F.lit(None).cast("string"))
    return parts.plan(rows, "auto", 4).select("doc_id", "path", "message")


def section_sql(body: str) -> str:
    label = "'Page ' || i || CASE WHEN c > 1 THEN ' of ' || c ELSE '' END"
    return f"'<section id=\"page-' || i || '\" class=\"part\" data-part=\"' || i || '\" aria-label=\"' || {label} || '\">' || {body} || '</section>'"


LOADING_SQL = "'<p class=\"loading\">Converting page ' || i || CASE WHEN c > 1 THEN ' of ' || c ELSE '' END || '…</p>'"


@query(f"""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, page_id, url, page_id % 6 AS c, unnest(generate_series(1, page_id % 6)) AS i FROM pages WHERE page_id % 6 > 0)
SELECT doc_id, CAST(i AS BIGINT) AS pos, 'append' AS type, 'page-' || i AS id, {section_sql(LOADING_SQL)} AS html, NULL AS phase FROM p
UNION ALL SELECT DISTINCT doc_id, CAST(c + 1 AS BIGINT), 'progress', NULL, NULL, 'Converting ' || c || CASE WHEN c = 1 THEN ' page' ELSE ' pages' END FROM p
UNION ALL SELECT doc_id, CAST(c + 1 + i AS BIGINT), 'replace', 'page-' || i, CASE WHEN (page_id + i) % 7 = 0 THEN {section_sql("'<p class=\"error\" role=\"alert\">Page ' || i || ' could not be converted. Lost &amp; gone</p>'")} ELSE {section_sql("'<p>' || " + esc('url') + " || '</p>'")} END, NULL FROM p""")
def part_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaffolds, progress notes and sections of parts, some of them failed."""
    docs = paged(spark, sf_dir).filter(F.col("count") > 0)
    each = docs.withColumn("index", F.explode(F.sequence(F.lit(1), "count")))
    made = each.select("doc_id", "unit", "index", F.col("count").alias("total"), F.array(F.concat(F.lit("<p>"), T.escape_html(F.col("url")), F.lit("</p>"))).alias("blocks"), F.when((F.col("doc_id").cast("long") + F.col("index")) % 7 == 0, "Lost & gone").alias("error"))
    return parts.scaffold(docs).unionByName(parts.part_events(made)).select("doc_id", "pos", "type", "id", "html", "phase")


def model_text(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    one = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.lit("hidden").alias("text"), F.lit(True).alias("thought")), F.struct(line.alias("text"), F.lit(False).alias("thought"))).alias("parts")).alias("content"))).alias("candidates"))
    two = F.struct(F.array(F.struct(F.struct(line.alias("content")).alias("delta"))).alias("choices"))
    frame = F.concat(F.lit("data: "), F.to_json(one if kind == "candidates" else two), F.lit("\r\n\r\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", frame.alias("frame")))), lambda x: x.frame), "")
    whole = F.concat(body, F.lit("data: {broken\r\n: comment\r\n"), F.lit("data: [DONE]\r\n" if kind == "choices" else "data:\r\n"))
    return lines(spark, sf_dir).groupBy("doc_id").agg(whole.alias("body")).select("doc_id", scans.deltas(F.col("body"), kind).alias("deltas"))


DELTA_SQL = f"SELECT doc_id, CAST(count(*) FILTER (line <> '') AS INT) AS n, coalesce(string_agg(line, '|' ORDER BY pos) FILTER (line <> ''), '') AS text FROM ({LINE_SQL}) GROUP BY doc_id"


@query(DELTA_SQL)
def candidate_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of candidate streams decoded to text."""
    return model_text("candidates", spark, sf_dir).select("doc_id", F.size("deltas").alias("n"), F.array_join("deltas", "|").alias("text"))


@query(DELTA_SQL)
def choice_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of chat streams decoded to text."""
    return model_text("choices", spark, sf_dir).select("doc_id", F.size("deltas").alias("n"), F.array_join("deltas", "|").alias("text"))


@query("""SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 403 WHEN page_id % 13 = 0 THEN 413 WHEN page_id % 5 = 4 THEN 415 WHEN page_id % 17 = 0 THEN 400 WHEN page_id % 5 = 0 THEN 422 END AS status,
CASE WHEN page_id % 11 = 0 THEN 'Cross-site uploads are refused.' WHEN page_id % 13 = 0 THEN 'The file is larger than 50 MB.' WHEN page_id % 5 = 4 THEN 'Unsupported file type (text/csv). Supported: application/pdf, image/png, image/jpeg, image/webp.' WHEN page_id % 17 = 0 THEN 'The file is empty.' WHEN page_id % 5 = 0 THEN 'The file is not a readable PDF.' END AS message FROM pages""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads through the ladder of checks."""
    i = F.col("page_id")
    types = F.array(*map(F.lit, (*scans.UPLOAD_TYPES, "text/csv")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(i % 11 == 0, "cross-site").otherwise("same-origin").alias("site"), F.when(i % 13 == 0, 60 << 20).otherwise(1000).alias("content_length"), F.lit(None).cast("string").alias("form_error"), F.get(types, (i % 5).cast("int")).alias("media_type"), F.when(i % 17 == 0, F.lit("")).otherwise(F.col("url")).cast("binary").alias("content"), F.lit("k").alias("api_key"))
    return scans.check_upload(rows).select("page_id", "status", "message")


@query("""SELECT page_id, '<figure data-page="7"><figcaption>' || url || '</figcaption></figure>' AS stamped, '<figure data-page="7" data-bbox="1,2"></figure>' AS placed, '<div class="table-scroll"><table><tr></tr></table></div>' AS boxed, '<p id="b' || page_id || '" data-page="2">x</p>' AS named, least(600 * (1 << CAST(page_id % 6 AS INT)), 5000) AS wait FROM pages""")
def html_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on elements, and the waits between attempts."""
    figure = F.concat(F.lit('<figure data-page="1"><figcaption>'), F.col("url"), F.lit("</figcaption></figure>"))
    return table(spark, sf_dir, "pages").select(
        "page_id", T.stamp_figure_page(figure, F.lit(7)).alias("stamped"), T.stamp_figure_page(F.lit('<figure data-bbox="1,2"></figure>'), F.lit(7)).alias("placed"), T.wrap_table(F.lit("<table><tr></tr></table>")).alias("boxed"),
        T.with_root_id(F.lit('<p data-page="2" id="old">x</p>'), F.concat(F.lit("b"), F.col("page_id").cast("string"))).alias("named"), parts.backoff_ms((F.col("page_id") % 6).cast("int")).alias("wait"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chunks, one per turn."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.lit(None).cast("int").alias("part_index"), F.col("turn").alias("chunk_seq"), F.concat("text", F.lit("\n")).alias("delta"), F.lit(False).alias("is_last"))


TURN_SQL = "SELECT CAST(conv_id AS VARCHAR) AS doc_id, replace(replace(trim(regexp_replace(string_agg(text || chr(10), '' ORDER BY turn), '\\s+', ' ', 'g')), '<', '&lt;'), '>', '&gt;') AS body FROM conversations GROUP BY conv_id"


@query(f"""SELECT doc_id, CAST(CASE WHEN body = '' THEN 2 ELSE 3 END AS BIGINT) AS seq, 'done' AS status, CASE WHEN body = '' THEN '' ELSE '<p id="block-1">' || body || '</p>' END AS html FROM ({TURN_SQL})""")
def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks joined, cut, sanitized, numbered and folded: one shuffle for the join, one for the fold."""
    chunks = turns(spark, sf_dir)
    events = convert.ended(convert.whole_events(chunks), chunks.select("doc_id").distinct())
    return fold.fold(events).select("doc_id", "seq", "status", F.array_join(F.transform("blocks", lambda b: b.html), "\n").alias("html"))


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages cut, sanitized and normalized to numbered blocks."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), html.clean_blocks(F.col("html")).alias("blocks"))
    return html.number_blocks(rows)


@query()
def page_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages through the allowlist."""
    return table(spark, sf_dir, "pages").select("page_id", html.sanitize(F.col("html")).alias("html"))


def streamed(chunks: DataFrame) -> DataFrame:
    """The event log of chunks that go through the streaming engine, one micro-batch after the other until none is left."""
    import uuid

    from docloom.streaming import live

    spark = chunks.sparkSession
    top = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{top}/chunks")
    stream = spark.readStream.schema(chunks.schema).parquet(f"{top}/chunks")
    live.start(stream, f"{top}/log", f"{top}/state").awaitTermination()
    return live.follow(spark, f"{top}/log")


@query(f"""SELECT doc_id, CASE WHEN body = '' THEN 0 ELSE 1 END AS blocks, TRUE AS done FROM ({TURN_SQL})""")
def conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations through the streaming engine."""
    chunks = turns(spark, sf_dir).select("doc_id", F.col("chunk_seq").cast("long"), "delta", "is_last")
    first = chunks.groupBy("doc_id").agg(F.min("chunk_seq").alias("low"), F.max("chunk_seq").alias("high"))
    ends = first.select("doc_id", (F.col("high") - F.col("low") + 1).alias("chunk_seq"), F.lit("").alias("delta"), F.lit(True).alias("is_last"))
    log = streamed(chunks.join(first, "doc_id").select("doc_id", (F.col("chunk_seq") - F.col("low")).alias("chunk_seq"), "delta", "is_last").unionByName(ends))
    return log.groupBy("doc_id").agg(F.count(F.when(F.col("type") == "append", 1)).cast("int").alias("blocks"), F.max((F.col("type") == "done").cast("int")).cast("boolean").alias("done"))


# Conversion of sources by parsers


def made_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources: PDF files of 0 to 3 empty pages, the others images whose bytes are text."""
    from docloom.sources.pdf import simple_pdf

    @F.udf("binary")
    def pdf(n: int) -> bytes:
        return simple_pdf([(200, 100 + k) for k in range(n)])

    n = (F.col("page_id") % 4).cast("int")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("page_id"), n.alias("n"), "url")
    content = F.when(F.col("n") > 0, pdf("n")).otherwise(F.col("url").cast("binary"))
    media = F.when(F.col("n") > 0, "application/pdf").otherwise("image/png")
    return rows.select("doc_id", content.alias("content"), media.alias("media_type"), F.concat(F.lit("f"), "doc_id").alias("name"))


def read_source(content: bytes, media_type: str, part):
    """A parser for the queries: the third part always fails, whole sources give a heading and open text."""
    if part is None:
        yield "<h1>Whole</h1><scr"
        yield f"ipt>x</script><p>{media_type}"
    elif part == 3:
        raise RuntimeError("Lost & gone")
    else:
        yield "<table><tr><td>"
        yield f"{int(part)} of {part.total}</td></tr></table><p onclick=x>{part.unit}</p>"


WHOLE_SQL = """CASE page_id % 4 WHEN 0 THEN '<h1 id="block-1">Whole</h1><p id="block-2">image/png</p>' WHEN 1 THEN '<h1 id="block-1">Whole</h1><p id="block-2">application/pdf</p>' END"""
PART_BODY_SQL = """CASE WHEN i = 3 THEN '<p class="error" role="alert">Page 3 could not be converted. Lost &amp; gone</p>' ELSE '<table><tr><td>' || i || ' of ' || c || '</td></tr></table><p>page</p>' END"""


@query(f"""WITH p AS (SELECT page_id, page_id % 4 AS c, unnest(generate_series(1, page_id % 4)) AS i FROM pages WHERE page_id % 4 > 1),
s AS (SELECT page_id, string_agg({section_sql(PART_BODY_SQL)}, '' ORDER BY i) AS html, 2 * max(c) + 2 AS seq FROM p GROUP BY page_id)
SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(coalesce(seq, 4) AS BIGINT) AS seq, 'done' AS status, coalesce(s.html, {WHOLE_SQL}) AS html FROM pages LEFT JOIN s USING (page_id)""")
def convert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources split, parsed, checked and folded; a failed part stays in its place."""
    from docloom.sources.registry import function_parser

    parser = function_parser(read_source, wait=lambda n: 0)
    done = convert.render(made_sources(spark, sf_dir), parser)
    return done.select("doc_id", "seq", "status", F.array_join(F.transform("blocks", lambda b: b.html), "").alias("html"))


@query("""SELECT CAST(page_id AS VARCHAR) AS doc_id, CASE WHEN page_id % 4 > 2 OR page_id % 4 = 0 THEN 'error' ELSE 'done' END AS status,
CASE WHEN page_id % 4 > 2 THEN '<p id="error" class="error" role="alert">The document has 3 pages; the limit is 2.</p>' WHEN page_id % 4 = 0 THEN '<p id="error" class="error" role="alert">No splitter is available for image/png.</p>' END AS html FROM pages""")
def split_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion in split mode: other sources, and more parts than allowed, are errors."""
    from docloom.sources.registry import function_parser

    done = convert.render(made_sources(spark, sf_dir), function_parser(read_source), convert.Options(mode="split", max_parts=2))
    return done.select("doc_id", "status", F.when(F.col("status") == "error", F.element_at("blocks", -1)["html"]).alias("html"))


@query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, '#turn-' || i AS target, '<section id="turn-' || i || '" class="part" data-part="' || i || '" aria-label="Turn ' || i || CASE WHEN c > 1 THEN ' of ' || c ELSE '' END || '">'
|| CASE WHEN i % 5 = 4 THEN '<p class="error" role="alert">Turn ' || i || ' could not be converted. cut off</p>' ELSE '<h3>Turn ' || i || '</h3><div class="table-scroll"><table><tr><td>' || conv_id || '</td></tr><tr><td>b</td></tr></table></div>' END || '</section>' AS html, TRUE AS done FROM t""")
def live_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of documents through the streaming engine: the last state of each section."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.row_number().over(order).alias("part_index"), F.count("*").over(Window.partitionBy("conv_id")).cast("int").alias("total"))
    text = F.concat(F.lit("```html\n<h3>Turn "), F.col("part_index").cast("string"), F.lit("</h3><table><tr><td>"), F.col("doc_id"), F.lit("</td></tr><tr><td>b</td></tr></table>\n```"))
    size = F.ceil(F.length(text) / 9).cast("int")
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.struct(k.cast("long").alias("chunk_seq"), F.substr(text, k * 9 + 1, F.lit(9)).alias("delta"), (k == size - 1).alias("is_last")))
    chunks = rows.withColumn("c", F.explode(cut)).select("doc_id", "part_index", F.lit("turn").alias("unit"), "total", "c.*")
    lost = (F.col("part_index") % 5 == 4) & F.col("is_last")
    log = streamed(chunks.withColumn("error", F.when(lost, "cut off")))
    last = log.filter("type = 'replace'").groupBy("doc_id", "target").agg(F.max_by("html", "seq").alias("html"))
    return last.join(log.groupBy("doc_id").agg(F.bool_or(F.col("type") == "done").alias("done")), "doc_id")


def answers(spark: SparkSession, sf_dir: str, kind: str, text: Column, **how) -> DataFrame:
    """Pages through a model parser whose network is the page's own text as a stream of events."""
    import json

    from docloom.sources import registry

    def post(address, content, headers):
        said = json.loads(content)["text"]
        for k in range(0, len(said), 40):
            piece = said[k : k + 40]
            body = {"candidates": [{"content": {"parts": [{"text": "no", "thought": True}, {"text": piece}]}}]} if kind == "candidates" else {"choices": [{"delta": {"content": piece}}]}
            frame = f"data: {json.dumps(body)}\r\n\r\n".encode()
            yield frame[:30]
            yield frame[30:]
        yield b"data: [DONE]"

    parser = registry.model_parser("http://model.test", lambda c, m, p: json.dumps({"text": bytes(c).decode()}), kind, post=post, **how)
    sources = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), text.cast("binary").alias("content"), F.lit("image/png").alias("media_type"), F.lit(None).cast("string").alias("name"))
    done = convert.render(sources, parser)
    return done.select("doc_id", "status", F.array_join(F.transform("blocks", lambda b: b.html), "").alias("html"))


@query("""SELECT CAST(page_id AS VARCHAR) AS doc_id, 'done' AS status, '<h2 id="block-1" data-page="1">Page ' || page_id || '</h2><ul id="block-2"><li>a</li><li>b ' || page_id || '</li></ul><p id="block-3">end</p>' AS html FROM pages""")
def model_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout divs from a model's stream, wherever its events cut them, to documents."""
    i = F.col("page_id").cast("string")
    div = lambda label, body, more="": F.concat(F.lit(f'<div data-label="{label}"{more}>'), body, F.lit("</div>\n"))
    text = F.concat(div("Section-header", F.concat(F.lit("# Page "), i), ' data-page="1" data-bbox="1,2"'), div("list-item", F.lit("- a")), div("Page-footer", F.lit("7")), div("List_item", F.concat(F.lit("- b "), i)), div("odd", F.lit("end")))
    return answers(spark, sf_dir, "candidates", text, layout=True)


@query("""SELECT CAST(page_id AS VARCHAR) AS doc_id, 'done' AS status, '<h1 id="block-1">Page ' || page_id || '</h1><pre id="block-2"><code>a' || chr(10) || chr(10) || 'b</code></pre><p id="block-3">last <em>words</em></p>' AS html FROM pages""")
def model_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown from a model's stream to documents."""
    text = F.concat(F.lit("# Page "), F.col("page_id").cast("string"), F.lit("\n\n```\na\n\nb\n```\nlast *words*"))
    return answers(spark, sf_dir, "choices", text, markdown=True)


@query("""SELECT page_id, 'https://host.test/x?y=1&unit=page&index=' || (page_id % 9 + 1) || '&total=9' AS address, CASE WHEN page_id % 3 = 0 THEN 'This parser reads images, not text/csv.' END AS error FROM pages""")
def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts posted to a service, which answers with the address it got; sources of a wrong kind are refused."""
    from docloom.sources import registry

    def post(address, content, headers):
        yield address.encode()

    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.lit(b"x").alias("content"), F.when(F.col("page_id") % 3 == 0, "text/csv").otherwise("image/png").alias("media_type"), (F.col("page_id") % 9 + 1).cast("int").alias("part_index"), F.lit("page").alias("unit"), F.lit(9).alias("total"))
    said = registry.http_parser("https://host.test/x?y=1", "key", post=post)(rows).filter("not is_last").select("doc_id", F.col("delta").alias("address"))
    refused = registry.model_parser("http://model.test", lambda c, m, p: "{}", "choices", post=lambda *x: iter(())).retrying(0)(rows).groupBy("doc_id").agg(F.min("error").alias("error"))
    return said.join(refused, "doc_id").select(F.col("doc_id").cast("long").alias("page_id"), "address", "error")


# Functions on markup, sources and sinks


@query(ELEMENT_SQL)
def layout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divs from chunks that cut them anywhere, decoded to typed elements."""
    text = div_rows(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "div"))), lambda x: x.div), "\n").alias("text"))
    n = F.ceil(F.length("text") / 61).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.cast("long").alias("chunk_seq"), F.substr(F.col("text"), k * 61 + 1, F.lit(61)).alias("delta")))
    chunks = text.select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.*")
    e = layout_ops.elements(chunks)
    return e.select("doc_id", "pos", "element.label", F.array_join(F.col("element.bbox").cast("array<string>"), ",").alias("bbox"), "element.page", "element.content")


@query(f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS pos, CASE WHEN pos % 3 = 0 THEN '```' || chr(10) || line || chr(10) || chr(10) || 'x' || chr(10) || '~~~' ELSE line END AS block FROM ({MD_SQL})""")
def markdown_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with fences that hold blank lines, cut to blocks."""
    line = T.trim(F.col("line"))
    piece = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("```\n"), line, F.lit("\n\nx\n~~~"))).otherwise(line)
    texts = lines(spark, sf_dir).filter(line != "").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("p")))), lambda x: x.p), "\n \n").alias("text"))
    return texts.select("doc_id", F.posexplode(html.cut_markdown(F.col("text"))).alias("pos", "block"))


@query(f"""SELECT page_id, '<figure data-page="' || page_id || '"><img src="' || {text_sql('url')} || '" alt="shot ' || page_id || '"><figcaption>shot ' || page_id || '</figcaption></figure>' AS image, '<figure><figcaption>shot ' || page_id || '</figcaption></figure>' AS local,
'<h3 data-page="' || page_id || '">p <strong>' || page_id || '</strong></h3>' AS heading, '<hr>' AS rule FROM pages""")
def markdown_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, headings and rules of markdown, with a part's page on the root."""
    i = F.col("page_id").cast("string")
    page = M.page_attribute(F.lit("page"), i)
    image = F.concat(F.lit("![shot "), i, F.lit("]("), F.col("url"), F.lit(")"))
    local = F.concat(F.lit("[Image: shot "), i, F.lit("]"))
    return table(spark, sf_dir, "pages").select("page_id", M.block_html(image, page).alias("image"), M.block_html(local, M.page_attribute(F.lit("sheet"), i)).alias("local"), M.block_html(F.concat(F.lit("### p **"), i, F.lit("**")), page).alias("heading"), M.block_html(F.lit("***")).alias("rule"))


@query("""WITH p AS (SELECT page_id, page_id % 4 AS k, '<li>' || page_id || '</li>' AS li FROM pages)
SELECT page_id, CASE WHEN k > 0 THEN '<ul>' || repeat(li, CAST(k AS INT)) || '</ul>' END AS shown, CASE WHEN k > 0 THEN CAST(k AS INT) END AS children, CASE WHEN k < 2 THEN '<p id="b' || page_id || '">x</p>' ELSE '<p>x</p>' END AS sound,
k <> 2 AS complete, k < 2 AS single FROM p""")
def structure_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lists closed for now, unbalanced markup degraded, and single blocks told apart."""
    i = F.col("page_id")
    k = (i % 4).cast("int")
    item = F.concat(F.lit("<li>"), i.cast("string"), F.lit("</li>"))
    shown = html.provisional(F.concat(F.lit(" <ul>"), F.array_join(F.array_repeat(item, k), ""), F.lit("<li>op")))
    name = F.concat(F.lit("b"), i.cast("string"))
    own = F.concat(F.lit('<p id="'), name, F.lit('">x'), F.when(k == 2, F.lit("</div>")).otherwise(F.lit("</p>")))
    both = F.concat(own, F.when(k == 3, F.lit("<br>")).otherwise(F.lit("")))
    first = F.when(k < 2, F.get(html.normalize(own), F.lit(0))).otherwise(F.get(html.normalize(F.lit("<p>x</div>")), F.lit(0)))
    return table(spark, sf_dir, "pages").select("page_id", shown.alias("s"), first.alias("sound"), html.is_complete(own).alias("complete"), html.is_single_block(both, name).alias("single")).select("page_id", F.col("s.html").alias("shown"), F.col("s.children").alias("children"), "sound", "complete", "single")


@query(f"""SELECT page_id, '<p>x ' || page_id || '<a>bad</a><a href="http://e.test/' || page_id || '" rel="noopener noreferrer nofollow">good</a></p>' AS links, '<table><tr><td colspan="2">' || page_id || '</td></tr></table>' AS kept, 'after ' || page_id AS dropped,
'<figure data-page="3"><figcaption>[' || page_id || ']</figcaption></figure>' AS handled FROM pages""")
def sanitized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allowlist on markup whose clean form is known, and a handler that rewrites text and attributes."""
    from docloom.functions.sanitizer import handler, text_handler

    i = F.col("page_id").cast("string")
    links = F.concat(F.lit('<section><p onclick="go()" style="x">x '), i, F.lit('<a href="java&#115;cript:go()">bad</a><a target=_top href="http://e.test/'), i, F.lit('">good</a><!-- '), i, F.lit(" --></p></section>"))
    kept = F.concat(F.lit("<div class=a><table width=9><tr><td colspan='2' bgcolor=red>"), i, F.lit("</td></tr></table></div>"))
    dropped = F.concat(F.lit("<script>if (a < b) '</p>'</script><svg><p>z</p></svg><textarea><b>t</b></textarea>after "), i)
    own = (text_handler("*", lambda t: f"[{t}]"), handler("figure", lambda: {"element": lambda e: e.set("data-page", "3")}))
    figure = F.concat(F.lit("<figure><figcaption>"), i, F.lit("</figcaption></figure>"))
    return table(spark, sf_dir, "pages").select("page_id", html.sanitize(links).alias("links"), html.sanitize(kept).alias("kept"), html.sanitize(dropped).alias("dropped"), html.sanitize(figure, own).alias("handled"))


NAMES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("SELECT name || '.parquet' AS name, name AS title, NULL AS media_type, 'Unknown file type: ' || name || '.parquet' AS error FROM (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ") AS t(name)")
def file_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as sources, by their names, whether one file or a folder of part files; their type is none that can be read."""
    ship(spark)
    return scans.read_files(spark, sf_dir, "*.parquet", folders=True).select("name", "title", "media_type", "error")


@query("""SELECT page_id, '{"model":"m","stream":true,"temperature":0,"messages":[{"role":"user","content":[{"type":"text","text":"' || '""" + scans.HTML_PROMPT + """ This is page ' || page_id || ' of 9."},{"type":"image_url","image_url":{"url":"data:image/png;base64,' || base64(encode(url)) || '"}}]}]}' AS choices,
'{"system_instruction":{"parts":[{"text":"be exact"}]},"contents":[{"role":"user","parts":[{"inline_data":{"mime_type":"image/png","data":"' || base64(encode(url)) || '"}},{"text":"go"}]}],"generationConfig":{"temperature":0,"maxOutputTokens":16384,"thinkingConfig":{"thinkingBudget":32768}}}' AS candidates, TRUE AS image, FALSE AS pdf FROM pages""")
def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies for both kinds of models, with prompts of parts."""
    media, content = F.lit("image/png"), F.col("url").cast("binary")
    prompt = scans.part_prompt(F.lit("page"), F.col("page_id"), F.lit(9))
    return table(spark, sf_dir, "pages").select("page_id", scans.choice_request("m", media, content, prompt).alias("choices"), scans.candidate_request(media, content, F.lit("be exact"), F.lit("go")).alias("candidates"), scans.is_image(media).alias("image"), scans.is_pdf(media).alias("pdf"))


@query(f"""WITH {STATE_SQL} SELECT doc_id, status, '{{"title":"Document ' || doc_id || '","seq":' || seq || ',"status":"' || status || '","phase":"' || phase || '","blocks":[' || CASE WHEN blocks = '' THEN '' ELSE list_aggregate(list_transform(string_split(blocks, chr(10)), lambda x: '{{"id":"' || regexp_extract(x, '^([^=]*)=', 1) || '","html":"' || replace(regexp_replace(x, '^[^=]*=', ''), '"', '\\"') || '"}}'), 'string_agg', ',') END || ']}}' AS json,
CASE status WHEN 'done' THEN 'Done' WHEN 'error' THEN 'Failed' ELSE phase END AS said FROM state""")
def snapshot_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as JSON with their session's fields, and what a viewer says of their state."""
    state = fold.fold(event_inputs(spark, sf_dir)).withColumn("title", F.concat(F.lit("Document "), "doc_id"))
    return state.select("doc_id", "status", sinks.snapshot_json(["title"]).alias("json"), sinks.status_text(F.col("status"), F.col("phase")).alias("said"))


@query(f"""WITH {STATE_SQL} SELECT doc_id, status, seq, TRUE AS recent FROM state WHERE status <> 'running'""")
def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal snapshots stored by day and read back within retention; a day beyond it is dropped."""
    import uuid

    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    state = fold.fold(event_inputs(spark, sf_dir))
    sinks.save(state, path)
    sinks.save(state.withColumn("finished_on", F.date_sub(F.current_date(), 30)), path)
    sinks.expire(spark, path)
    return spark.read.parquet(path).select("doc_id", "status", "seq", (F.col("finished_on") == F.current_date()).alias("recent"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 4 THEN NULL WHEN page_id % 2 = 0 THEN 'a b-' || page_id || '.png' ELSE 'f' || page_id || '.PDF' END AS name, CASE WHEN page_id % 5 = 4 THEN NULL WHEN page_id % 2 = 0 THEN 'image/png' ELSE 'application/pdf' END AS media_type,
CASE WHEN page_id % 5 = 4 THEN NULL WHEN page_id % 2 = 0 THEN url ELSE 'bytes' END AS body, CASE WHEN page_id % 5 = 4 THEN NULL WHEN page_id % 2 = 0 THEN 'split' ELSE 'whole' END AS mode, CASE WHEN page_id % 5 = 4 THEN NULL WHEN page_id % 2 = 0 THEN 'k&1' ELSE 'key' END AS api_key,
CASE WHEN page_id % 5 = 4 AND page_id % 2 = 0 THEN 'Choose a file to upload.' WHEN page_id % 5 = 4 THEN 'The form could not be read.' END AS form_error FROM pages""")
def upload_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads as forms and as raw bodies, some without a file and some broken."""
    i, form = F.col("page_id"), F.lit("--b\r\nContent-Disposition: form-data; name=")
    file = F.concat(form, F.lit('"file"; filename="f'), i.cast("string"), F.lit('.PDF"\r\n\r\nbytes\r\n'))
    rest = F.concat(form, F.lit('"mode"\r\n\r\nwhole\r\n'), form, F.lit('"api_key"\r\n\r\nkey\r\n--b--\r\n'))
    odd, bad = i % 2 == 1, i % 5 == 4
    kind = F.when(bad & odd, "multipart/form-data").when(bad | odd, "multipart/form-data; boundary=b").otherwise("Image/PNG; x=1")
    body = F.when(bad, rest).when(odd, F.concat(file, rest)).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", kind.alias("content_type"), body.cast("binary").alias("body"), F.concat(F.lit("a%20b-"), i.cast("string"), F.lit(".png")).alias("x_filename"), F.lit("k&1").alias("x_api_key"), F.lit("/s?x=1&mode=split").alias("url"))
    return scans.read_uploads(rows).select("page_id", "name", "media_type", F.col("content").cast("string").alias("body"), "mode", "api_key", "form_error")
