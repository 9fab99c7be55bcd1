"""Sources: files, typed rows, plain text, uploads, and the bodies of model streams."""

from __future__ import annotations

import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.session import shipped

UPLOAD_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/webp")
UPLOAD_BYTES, FORM_BYTES = 50 << 20, 64 << 10


def source(content: Column, media_type: Column | str, name: Column | None = None) -> Column:
    """A source struct of bytes with their type."""
    media = F.lit(media_type) if isinstance(media_type, str) else media_type
    return F.struct(content.alias("content"), media.alias("media_type"), (F.lit(None).cast("string") if name is None else name).alias("name"))


def pdf(content: Column, name: Column | None = None) -> Column:
    return source(content, "application/pdf", name)


def png(content: Column, name: Column | None = None) -> Column:
    return source(content, "image/png", name)


def jpeg(content: Column, name: Column | None = None) -> Column:
    return source(content, "image/jpeg", name)


def plain(content: Column, name: Column | None = None) -> Column:
    return source(F.encode(content, "UTF-8"), "text/plain", name)


def is_pdf(media_type: Column) -> Column:
    return media_type == "application/pdf"


def is_image(media_type: Column) -> Column:
    return media_type.startswith("image/")


def read_files(spark: SparkSession, path: str, glob: str | None = None, folders: bool = False) -> DataFrame:
    """Files as sources; the title is the name without its extension, an unknown type gives an error text.

    With ``folders`` what lies in the folder ``path`` itself is read, and ``glob`` is held against its names: a folder
    there, such as a table of many part files, is one source under its own name, without content.
    """
    reader = spark.read.format("binaryFile")
    if folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        root = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString().rstrip("/")
        inside = F.substr("path", F.lit(len(root) + 2))
        rows = reader.option("recursiveFileLookup", "true").load(path).select(inside.alias("inside"), "content").filter(F.split_part("inside", F.lit("/"), F.lit(1)).rlike(fnmatch.translate(glob or "*")))
        parts = rows.filter(F.contains("inside", F.lit("/"))).select(F.split_part("inside", F.lit("/"), F.lit(1)).alias("inside")).distinct()
        rows = rows.filter(~F.contains("inside", F.lit("/"))).unionByName(parts, allowMissingColumns=True).select(F.concat(F.lit(root + "/"), "inside").alias("path"), "content")
    else:
        rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    media = T.media_type(name)
    error = F.when(media.isNull(), F.concat(F.lit("Unknown file type: "), name))
    return rows.select(F.col("path").alias("doc_id"), "content", media.alias("media_type"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*\z", "").alias("title"), error.alias("error"))


def paragraphs(text: Column, delimiter: str = r"\n\s*\n") -> Column:
    """The plain-text parser: trimmed pieces as HTML; ``# `` begins a heading."""
    pieces = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), delimiter), T.trim), lambda p: p != "")
    return F.transform(pieces, lambda p: F.when(p.startswith("# "), F.concat(F.lit("<h1>"), T.escape_html(F.substr(p, F.lit(3))), F.lit("</h1>"))).otherwise(F.concat(F.lit("<p>"), T.escape_html(p), F.lit("</p>"))))


def data_lines(body: Column) -> Column:
    """The payloads of a server-sent body's data lines; empty ones and the end mark are left out."""
    lines = F.filter(F.split(body, "\r?\n"), lambda x: x.startswith("data:"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.substr(x, F.lit(6)))), lambda x: (x != "") & (x != "[DONE]"))


CANDIDATES = "candidates array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>>>"
CHOICES = "choices array<struct<delta:struct<content:string>,message:struct<content:string>>>"


def candidate_text(chunk: Column) -> Column:
    """The text of the first candidate's parts that are no thoughts."""
    parts = F.coalesce(F.get(chunk["candidates"], F.lit(0))["content"]["parts"], F.array().cast("array<struct<text:string,thought:boolean>>"))
    return F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p.thought, F.lit(False))), lambda p: F.coalesce(p.text, F.lit(""))), "")


def choice_text(chunk: Column) -> Column:
    first = F.get(chunk["choices"], F.lit(0))
    return F.coalesce(first["delta"]["content"], first["message"]["content"], F.lit(""))


def deltas(body: Column, kind: str = "candidates") -> Column:
    """The text deltas of a whole response body; a line that is no JSON gives none."""
    schema, of = (CANDIDATES, candidate_text) if kind == "candidates" else (CHOICES, choice_text)
    return F.filter(F.transform(data_lines(body), lambda x: of(F.from_json(x, schema))), lambda t: t != "")


def part_url(url: Column, unit: Column, index: Column, total: Column) -> Column:
    """The address of a part at a service of one's own."""
    mark = F.when(F.instr(url, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return F.when(unit.isNull(), url).otherwise(F.concat(url, mark, F.lit("unit="), F.url_encode(unit), F.lit("&index="), index.cast("string"), F.lit("&total="), total.cast("string")))


def candidate_request(media: Column, content: Column, system: Column, prompt: Column, most_tokens: int = 16384, thinking: int = 32768) -> Column:
    """A request body with inline data, for services that answer with candidates."""
    data = F.struct(F.struct(media.alias("mime_type"), T.base64_of(content).alias("data")).alias("inline_data"))
    parts = F.struct(F.array(F.to_json(data), F.to_json(F.struct(prompt.alias("text")))).alias("p"))
    config = F.to_json(F.struct(F.lit(0).alias("temperature"), F.lit(most_tokens).alias("maxOutputTokens"), F.struct(F.lit(thinking).alias("thinkingBudget")).alias("thinkingConfig")))
    quoted = F.to_json(F.struct(system.alias("text")))
    return F.concat(F.lit('{"system_instruction":{"parts":['), quoted, F.lit(']},"contents":[{"role":"user","parts":['), F.array_join(parts["p"], ","), F.lit(']}],"generationConfig":'), config, F.lit("}"))


def choice_request(model: str, media: Column, content: Column, prompt: Column) -> Column:
    """A streaming chat request with an image, for services that answer with choices."""
    words = F.to_json(F.struct(F.lit("text").alias("type"), prompt.alias("text")))
    image = F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(T.data_url(media, content).alias("url")).alias("image_url")))
    return F.concat(F.lit('{"model":'), F.to_json(F.array(F.lit(model))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(model)))) - 2), F.lit(',"stream":true,"temperature":0,"messages":[{"role":"user","content":['), words, F.lit(","), image, F.lit("]}]}"))


#: Our own prompts.
LAYOUT_PROMPT = "Transcribe the page as a flat list of <div data-bbox=\"[ymin,xmin,ymax,xmax]\" data-label=\"Label\">content</div> elements in reading order, boxes from 0 to 1000."
LAYOUT_PAGES_PROMPT = LAYOUT_PROMPT + " Add data-page with the page's number, from 1, to each element."
HTML_PROMPT = "Convert the document to clean semantic HTML, without styles or scripts."
MARKDOWN_PROMPT = "Convert the page to markdown in reading order."


def layout_prompt(part: Column) -> Column:
    """A part is one page; a whole document may have many."""
    return F.when(part.isNotNull(), F.lit(LAYOUT_PROMPT)).otherwise(F.lit(LAYOUT_PAGES_PROMPT))


def part_prompt(unit: Column, index: Column, total: Column) -> Column:
    return F.when(unit.isNull(), F.lit(HTML_PROMPT)).otherwise(F.concat(F.lit(HTML_PROMPT + " This is "), unit, F.lit(" "), index.cast("string"), F.lit(" of "), total.cast("string"), F.lit(".")))


UPLOAD = "content binary, media_type string, name string, mode string, api_key string, form_error string"


def form_upload(body: bytes, content_type: str) -> tuple:
    """The file and fields of a multipart form (see UPLOAD), or what is wrong with it."""
    from email.parser import BytesParser
    from email.policy import HTTP

    form = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    if not form.is_multipart() or form.defects:
        return (None, None, None, None, None, "The form could not be read.")
    fields = {p.get_param("name", header="content-disposition"): p for p in form.iter_parts()}
    file = fields.get("file")
    if file is None or file.get_filename() is None:
        return (None, None, None, None, None, "Choose a file to upload.")
    own = file.get_content_type() if "content-type" in file else T.MEDIA_TYPES.get(file.get_filename().rpartition(".")[2].lower(), "")
    text = lambda name: fields[name].get_payload(decode=True).decode("utf-8", "replace") if name in fields else None
    return (file.get_payload(decode=True), own.lower(), file.get_filename(), text("mode"), text("api_key"), None)


def read_uploads(requests: DataFrame) -> DataFrame:
    """``requests`` (content_type, body, x_filename, x_api_key, url) with the columns of UPLOAD: forms by their
    fields, raw bodies by their headers and the address's mode. A form that can't be read has ``form_error``."""

    @F.arrow_udf(UPLOAD)
    def forms(body: pa.Array, kind: pa.Array) -> pa.Array:
        rows = [form_upload(b or b"", k) if k else (None,) * 6 for b, k in zip(body.to_pylist(), kind.to_pylist())]
        names = [x.split()[0] for x in UPLOAD.split(", ")]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.binary() if n == "content" else pa.string()) for c, n in zip(columns, names)], names=names)

    base = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
    form = base == "multipart/form-data"
    mode = F.regexp_extract("url", r"[?&]mode=([^&#]*)", 1)
    raw = {"content": F.col("body"), "media_type": base, "name": F.try_url_decode("x_filename"), "mode": F.nullif(F.try_url_decode(mode), F.lit("")), "api_key": F.col("x_api_key"), "form_error": F.lit(None).cast("string")}
    told = requests.withColumn("__form", shipped(forms)(F.col("body"), F.when(form, F.col("content_type"))))
    return told.withColumns({c: F.when(form, F.col(f"__form.{c}")).otherwise(x) for c, x in raw.items()}).drop("__form")


def check_upload(rows: DataFrame, types: tuple[str, ...] = UPLOAD_TYPES, most: int = UPLOAD_BYTES, key_needed: bool = False) -> DataFrame:
    """Adds status and message (null: accepted) to uploads: site, content_length, form_error, media_type, content, api_key.

    The checks stand in the order in which a service makes them; the first that fails answers.
    """
    large = F.lit(f"The file is larger than {round(most / (1 << 20))} MB.")
    media = F.coalesce("media_type", F.lit(""))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    known = F.concat(F.lit("Unsupported file type"), F.when(media != "", F.concat(F.lit(" ("), media, F.lit(")"))).otherwise(F.lit("")), F.lit(". Supported: " + ", ".join(types) + "."))
    steps = [
        (F.col("site") == "cross-site", 403, F.lit("Cross-site uploads are refused.")),
        (F.coalesce("content_length", F.lit(0)) > most + FORM_BYTES, 413, large),
        (F.col("form_error").isNotNull(), 400, F.col("form_error")),
        (~media.isin(*types), 415, known),
        (size == 0, 400, F.lit("The file is empty.")),
        (size > most, 413, large),
        (is_pdf(media) & ~T.looks_like_pdf(F.col("content")), 422, F.lit("The file is not a readable PDF.")),
        (F.lit(key_needed) & (F.trim(F.coalesce("api_key", F.lit(""))) == ""), 400, F.lit("Add your API key. It is used for this upload alone.")),
    ]
    status, message = F.lit(None).cast("int"), F.lit(None).cast("string")
    for fails, code, text in reversed(steps):
        fails = F.coalesce(fails, F.lit(False))
        status, message = F.when(fails, F.lit(code)).otherwise(status), F.when(fails, text).otherwise(message)
    return rows.withColumn("status", status).withColumn("message", message)
