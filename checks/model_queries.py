"""Prompts, models, transcripts, notes and messages out, over the whole tables."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import functions as F

from checks import expected as X
from checks.folders import work_folder
from checks.registry import query
from checks.text_queries import TRIM, sql_text, sql_words
from checks.views import AS_OF, table, wide
from contentflow import schema
from contentflow import values as V
from contentflow.functions import notes as N
from contentflow.functions import prompts as P
from contentflow.functions.dates import utc
from contentflow.operators import models as M
from contentflow.operators import note_files as K
from contentflow.operators import outbox as O
from contentflow.operators.stages import conform, process
from contentflow.plans.transcription import correct_transcripts, transcribe_items
from contentflow.sources.items import item_json, make_items

MODELS = [M.Model("alpha", "vendor_a/alpha-1"), M.Model("beta", "vendor_b/beta-1"), M.Model("gamma", "vendor_c/gamma-1")]
RECIPIENTS = ["r1@example.com", "r2@example.com"]


def doc_items(spark, sf, **more):
    """Documents as items with title and language in their metadata."""
    return make_items(
        wide(spark, sf, "documents"), content=F.col("text"), source=F.concat(F.lit("rss:"), F.col("source")),
        natural_key=F.col("doc_id"), timestamp=utc(AS_OF),
        metadata={"title": F.concat(F.lit("Title "), F.col("doc_id")), "lang": F.col("lang"), **more}, keep=("doc_id",),
    )


def _digest_model():
    """A stand-in model: tells the length and digest of the whole prompt, and fails for some lengths.

    Made as a closure, so that executors need not import this module.
    """

    def make():
        def complete(messages, params):
            prompt = messages[-1]["content"]
            if params["model"] == "vendor_b/beta-1" and len(prompt) % 11 == 0:
                raise RuntimeError("model is busy")
            if params["model"] == "vendor_c/gamma-1" and len(prompt) % 13 == 0:
                return {"model": params["model"]}
            text = f"{len(prompt)} {hashlib.md5(prompt.encode()).hexdigest()}"
            return {
                "choices": [{"message": {"content": text}}],
                "usage": {"prompt_tokens": len(prompt.split()), "completion_tokens": 2},
                "model": params["model"],
            }

        return complete

    return make


digest_completer = _digest_model()


# --- prompts and responses ---------------------------------------------------------------------

_NL = "chr(10)"


@query("prompt_messages", """SELECT doc_id, CAST(2 AS BIGINT) AS n, 'You write ' || lang || '.' AS system_message,
    'About Title ' || CAST(doc_id AS VARCHAR) || ' in ' || lang || ': ' || replace(text, '{lang}', lang) || ' {other}' AS prompt FROM documents""")
def prompt_messages(spark, sf):
    template = "About {title} in {lang}: {content} {other}"
    prompt = P.fill_prompt(template, F.col("content"), F.col("metadata"), ("content", "title", "lang", "other"))
    system = F.concat(F.lit("You write "), F.col("metadata")["lang"], F.lit("."))
    asked = doc_items(spark, sf).select("doc_id", P.prompt_messages(prompt, system).alias("m"))
    return asked.select(
        "doc_id", F.size("m").cast("bigint").alias("n"), F.get("m", F.lit(0))["content"].alias("system_message"),
        F.get("m", F.lit(1))["content"].alias("prompt"),
    )


_PRESET_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS preset, {sql_text(system)} AS system_message, {sql_text(head)} AS head"
    for name, head, system in X.PRESETS
)


@query("prompt_presets", f"SELECT doc_id, preset, system_message, head || text AS prompt FROM documents CROSS JOIN ({_PRESET_SQL})")
def prompt_presets(spark, sf):
    models = [
        M.Model(name, name, template, system) for name, (template, system) in V.PROMPT_PRESETS.items()
    ]
    fanned = M.with_prompts(M.fan_out(doc_items(spark, sf).select("doc_id", "content"), models), models)
    return fanned.select(
        "doc_id", F.col("name").alias("preset"), F.get("messages", F.lit(0))["content"].alias("system_message"),
        F.get("messages", F.lit(1))["content"].alias("prompt"),
    )


# Responses: chat turns as answers; system turns are odd responses, short user turns report no usage.
_RESPONSE_CASES = "CASE WHEN role = 'system' THEN 'odd' WHEN role = 'user' THEN 'bare' ELSE 'full' END"


@query("parse_response", f"""SELECT conv_id, turn, kind <> 'odd' AS success, CASE WHEN kind <> 'odd' THEN text END AS content,
    CASE kind WHEN 'full' THEN turn + 10 WHEN 'bare' THEN 0 END AS tokens_in,
    CASE kind WHEN 'full' THEN conv_id WHEN 'bare' THEN 0 END AS tokens_out,
    CASE kind WHEN 'full' THEN 'vendor' WHEN 'bare' THEN 'local' END AS provider,
    CASE WHEN kind = 'odd' THEN 'Unexpected API response format' END AS error_message
    FROM (SELECT *, {_RESPONSE_CASES} AS kind FROM conversations)""")
def parse_response(spark, sf):
    choices = F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")
    usage = F.struct((F.col("turn") + 10).alias("prompt_tokens"), F.col("conv_id").alias("completion_tokens")).alias("usage")
    full = F.to_json(F.struct(choices, usage, F.lit("vendor/m-1").alias("model")))
    bare = F.to_json(F.struct(choices, F.lit("local").alias("model")))
    odd = F.to_json(F.struct(F.col("text").alias("error")))
    body = F.when(F.col("role") == "system", odd).when(F.col("role") == "user", bare).otherwise(full)
    chat = wide(spark, sf, "conversations").select("conv_id", "turn", P.parse_response(body).alias("r"))
    return chat.select("conv_id", "turn", "r.*")


@query("approx_tokens", f"""SELECT doc_id, 5 + {sql_words('text')} AS tokens_in, {sql_words('text')} AS tokens_out FROM documents""")
def approx_tokens(spark, sf):
    messages = P.prompt_messages(F.col("text"), "You are a careful reader.")
    return wide(spark, sf, "documents").select("doc_id", P.approx_tokens(messages, F.col("text")).alias("t")).select("doc_id", "t.*")


@query("transcript_prompts", f"""SELECT doc_id, {" || ".join(
        {"{title}": "'Title ' || CAST(doc_id AS VARCHAR)", "{sample}": "substr(text, 1, 4000)"}.get(part, sql_text(part))
        for part in X.DOMAIN_PROMPT.replace("{title}", "|{title}|").replace("{sample}", "|{sample}|").split("|"))} AS domain_prompt,
    {" || ".join({"{domain}": "lang", "{transcript}": "text"}.get(part, sql_text(part))
        for part in X.CORRECTION_PROMPT.replace("{domain}", "|{domain}|").replace("{transcript}", "|{transcript}|").split("|"))}
    AS correction_prompt FROM documents""")
def transcript_prompts(spark, sf):
    docs = wide(spark, sf, "documents")
    title = F.concat(F.lit("Title "), F.col("doc_id"))
    return docs.select(
        "doc_id", P.domain_prompt(title, F.col("text")).alias("domain_prompt"),
        P.correction_prompt(F.col("lang"), F.col("text")).alias("correction_prompt"),
    )


@query("parse_correction", f"""SELECT doc_id, CASE WHEN lang = 'de' THEN 'original' ELSE trim(text, {TRIM}) END AS corrected,
    CASE WHEN lang = 'de' THEN 'Error in correction format' ELSE '- ' || source END AS corrections FROM documents""")
def parse_correction(spark, sf):
    answer = F.concat(F.lit("CORRECTED TRANSCRIPT:\n"), F.col("text"), F.lit("\n\nCHANGES MADE:\n- "), F.col("source"), F.lit("\n"))
    doubled = F.concat(answer, F.lit("\nCHANGES MADE: again"))
    body = F.when(F.col("lang") == "de", doubled).otherwise(answer)
    docs = wide(spark, sf, "documents").select("doc_id", P.parse_correction(body, F.lit("original")).alias("p"))
    return docs.select("doc_id", "p.*")


# --- models ------------------------------------------------------------------------------------


@query("model_fanout", "SELECT doc_id, CAST(model_ord AS BIGINT) AS model_ord, name, model_id FROM documents CROSS JOIN models")
def model_fanout(spark, sf):
    fanned = M.fan_out(table(spark, sf, "documents").select("doc_id"), MODELS)
    return fanned.select("doc_id", F.col("model_ord").cast("bigint").alias("model_ord"), "name", "model_id")


@query("model_catalogue", "SELECT doc_id, model_ord, name, model_id, max_tokens, temperature FROM documents CROSS JOIN (VALUES "
    + ", ".join(
        f"(CAST({i} AS BIGINT), '{name}', '{model}', '{most}', '0.7')"
        for i, (name, model, most) in enumerate(X.MODELS, start=1)
    ) + ") AS t(model_ord, name, model_id, max_tokens, temperature)")
def model_catalogue(spark, sf):
    fanned = M.fan_out(table(spark, sf, "documents").select("doc_id"), M.catalogue())
    params = F.from_json("params", "map<string,string>")
    return fanned.select(
        "doc_id", F.col("model_ord").cast("bigint").alias("model_ord"), "name", "model_id",
        params["max_tokens"].alias("max_tokens"), params["temperature"].alias("temperature"),
    )


def made_results(spark, sf):
    """The same results as the SQL view of this name."""
    fanned = M.fan_out(wide(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), MODELS)
    size = F.length("text")
    failed = ((F.col("model_ord") == 1) & (size % 7 == 0)) | ((F.col("model_ord") == 2) & (size % 11 == 0))
    answer = F.concat("name", F.lit(": "), "text")
    return fanned.select(
        "id", "model_ord", "name", "model_id", F.col("model_id").alias("model_name"), (~failed).alias("success"),
        F.when(failed, F.col("text")).otherwise(answer).alias("content"),
        (F.col("model_ord") * 10.25).cast("double").alias("execution_time_ms"),
        F.when(failed, "busy").alias("error_message"),
    )


@query("combine_markdown", f"""SELECT id, '# Combined Results' || {_NL} || {_NL} || string_agg('## ' || name || ' (' || model_id || ')'
    || {_NL} || {_NL} || content || {_NL} || {_NL} || '*Processed in ' || printf('%.2f', ms) || 'ms*' || {_NL} || {_NL} || '---' || {_NL} || {_NL},
    '' ORDER BY model_ord) AS content, bool_or(success) AS success FROM results GROUP BY id""")
def combine_markdown(spark, sf):
    return M.combine(made_results(spark, sf))


@query("combine_text", f"SELECT id, string_agg(content, {_NL} || {_NL} ORDER BY model_ord) AS content, bool_or(success) AS success FROM results GROUP BY id")
def combine_text(spark, sf):
    return M.combine(made_results(spark, sf), "text")


@query("first_success", """SELECT id, name, content, success FROM (SELECT *, row_number() OVER (PARTITION BY id
    ORDER BY NOT success, model_ord) AS k FROM results) WHERE k = 1""")
def first_success(spark, sf):
    return M.first_success(made_results(spark, sf), ["name", "content", "success"])


# Where the first model failed, no result was kept at all; the others' failures stay rows.
@query("no_results", """SELECT doc_id AS id, CASE WHEN length(text) % 7 = 0 THEN text ELSE 'alpha: ' || text END AS content,
    length(text) % 7 <> 0 AS success, CASE WHEN length(text) % 7 = 0 THEN 'No results from any processor' END AS error_message
    FROM documents""")
def no_results(spark, sf):
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    results = made_results(spark, sf)
    lost = results.filter("model_ord = 1 AND NOT success").select("id")
    return M.first_success_of(items, results.join(lost, "id", "left_anti"))


def answered(spark, sf):
    """Documents through the stand-in models, answers kept in a table so that each call is made once."""
    requests = M.with_prompts(M.fan_out(doc_items(spark, sf), MODELS), MODELS)
    folder = work_folder(spark, "answers")
    M.complete(requests, digest_completer, retries=2, retry_seconds=0.0).write.parquet(folder)
    return M.with_answers(requests, spark.read.parquet(folder))


_PROMPT = f"{sql_text(X.DEFAULT_PROMPT_HEAD)} || text"
_CALLS = f"""SELECT doc_id, CAST(model_ord AS BIGINT) AS model_ord, name, model_id, text, prompt,
    model_ord = 2 AND length(prompt) % 11 = 0 AS busy, model_ord = 3 AND length(prompt) % 13 = 0 AS odd
    FROM (SELECT *, {_PROMPT} AS prompt FROM documents) CROSS JOIN models"""


@query("batch_model", f"""SELECT doc_id, model_ord, NOT busy AND NOT odd AS success, CASE WHEN busy OR odd THEN text
        ELSE CAST(length(prompt) AS VARCHAR) || ' ' || md5(prompt) END AS content,
    CASE WHEN busy THEN 'LLM error: model is busy' WHEN odd THEN 'Unexpected API response format' END AS error_message,
    CASE WHEN NOT busy AND NOT odd THEN string_split(model_id, '/')[1] END AS provider,
    CAST(CASE WHEN busy THEN 2 ELSE 1 END AS BIGINT) AS calls FROM ({_CALLS})""")
def batch_model(spark, sf):
    return answered(spark, sf).select(
        "doc_id", F.col("model_ord").cast("bigint").alias("model_ord"), "success", "content", "error_message",
        F.try_element_at("metadata", F.lit("model_provider")).alias("provider"),
        F.col("result_metrics.call_count").cast("bigint").alias("calls"),
    )


@query("token_usage", f"""SELECT name, CAST(sum(CASE WHEN busy THEN 2 ELSE 1 END) AS BIGINT) AS call_count,
    CAST(sum(CASE WHEN busy OR odd THEN 1 ELSE 0 END) AS BIGINT) AS errors,
    CAST(sum(CASE WHEN busy OR odd THEN 0 ELSE {sql_words('prompt')} END) AS BIGINT) AS tokens_in,
    CAST(sum(CASE WHEN busy OR odd THEN 0 ELSE 2 END) AS BIGINT) AS tokens_out FROM ({_CALLS}) GROUP BY name""")
def token_usage(spark, sf):
    return M.usage(answered(spark, sf), "name").drop("execution_time_ms")


def _correcting_model():
    """A stand-in model for both steps of a correction."""

    def make():
        def complete(messages, params):
            prompt = messages[-1]["content"]
            if prompt.startswith("Given the following podcast title"):
                if len(prompt) % 7 == 0:
                    raise RuntimeError("busy")
                text = f" Field {len(prompt) % 3} "
            else:
                code = hashlib.md5(prompt.encode()).hexdigest()
                text = f"CORRECTED TRANSCRIPT:\nfixed {code}\n\nCHANGES MADE:\n- one" if len(prompt) % 5 else "as it was"
            return {"choices": [{"message": {"content": text}}], "model": params["model"]}

        return complete

    return make


def keep_in(spark, name):
    """Stores the answers of a step in the work folder."""
    folder = work_folder(spark, name)

    def keep(step, answers):
        answers.write.mode("overwrite").parquet(f"{folder}/{step}")
        return spark.read.parquet(f"{folder}/{step}")

    return keep


_DOMAIN_SQL = " || ".join(
    {"{title}": "'Title ' || CAST(doc_id AS VARCHAR)", "{sample}": "substr(text, 1, 4000)"}.get(part, sql_text(part))
    for part in X.DOMAIN_PROMPT.replace("{title}", "|{title}|").replace("{sample}", "|{sample}|").split("|")
)
_FIX_SQL = " || ".join(
    {"{domain}": "domain", "{transcript}": "text"}.get(part, sql_text(part))
    for part in X.CORRECTION_PROMPT.replace("{domain}", "|{domain}|").replace("{transcript}", "|{transcript}|").split("|")
)


@query("correct_transcripts", f"""WITH d AS (SELECT doc_id, text, {_DOMAIN_SQL} AS p FROM documents),
    n AS (SELECT doc_id, text, CASE WHEN length(p) % 7 = 0 THEN 'General' ELSE 'Field ' || CAST(length(p) % 3 AS VARCHAR) END AS domain FROM d),
    f AS (SELECT *, {_FIX_SQL} AS q FROM n)
    SELECT doc_id, domain, CASE WHEN length(q) % 5 = 0 THEN text ELSE 'fixed ' || md5(q) END AS corrected_text,
    CASE WHEN length(q) % 5 = 0 THEN 'Error in correction format' ELSE '- one' END AS corrections FROM f""")
def corrected(spark, sf):
    docs = wide(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("Title "), F.col("doc_id")).alias("title"), F.col("text").alias("transcript")
    )
    done = correct_transcripts(
        docs, _correcting_model(), keep_in(spark, "corrections"), retries=1, retry_seconds=0.0
    )
    return done.select("doc_id", "domain", "corrected_text", "corrections")


@query("transcribe_items", f"""SELECT doc_id, lang <> 'fr' AS success, CASE WHEN lang = 'fr' THEN text ELSE '# Transcription' || {_NL} || {_NL}
    || '**[00:00 - 01:15]** ' || trim(text, {TRIM}) || {_NL} || {_NL} END AS content, CASE WHEN lang = 'fr' THEN
    'Transcription error: no speech result for this item' END AS error_message, CASE WHEN lang <> 'fr' THEN '1' END AS segments,
    CASE WHEN lang <> 'fr' THEN 'No domain correction applied' END AS corrections, CASE WHEN lang <> 'fr' THEN text END AS corrected_text
    FROM documents""")
def transcribed(spark, sf):
    docs = wide(spark, sf, "documents")
    guid = F.concat(F.lit("d"), F.col("doc_id"))
    items = doc_items(spark, sf, guid=guid).withColumn("content_type", F.lit("audio"))
    segment = F.struct(F.lit(0.0).alias("start"), F.lit(75.9).alias("end"), F.col("text").alias("text"))
    speech = docs.filter("lang <> 'fr'").select(
        guid.alias("guid"), "text", F.array(segment).alias("segments"), F.col("lang").alias("language"),
        F.lit(75.9).alias("duration"),
    )
    done = transcribe_items(items.drop("doc_id"), speech, keep_in(spark, "speech"))
    meta = F.col("metadata")
    return done.select(
        F.expr("CAST(substr(metadata['guid'], 2) AS BIGINT)").alias("doc_id"), "success", "content", "error_message",
        meta["segments"].alias("segments"), meta["corrections"].alias("corrections"),
        meta["corrected_text"].alias("corrected_text"),
    )


@query("process_stage", """SELECT 'docs' AS origin, doc_id AS key, lang <> 'es' AS success, CASE WHEN lang = 'es' THEN text ELSE upper(source) END AS content,
    CASE WHEN lang = 'es' THEN 'Cannot handle data of type image' END AS error_message FROM documents
    UNION ALL SELECT 'chat', conv_id * 100 + turn, true, upper(role), NULL FROM conversations""")
def process_stage(spark, sf):
    docs = doc_items(spark, sf, origin=F.lit("docs"), key=F.col("doc_id"), label=F.col("source")).drop("doc_id")
    docs = docs.withColumn("content_type", F.when(F.col("metadata")["lang"] == "es", "image").otherwise("text"))
    chat = make_items(
        table(spark, sf, "conversations"), content=F.col("text"), source="chat", natural_key=F.col("conv_id") * 100 + F.col("turn"),
        metadata={"origin": F.lit("chat"), "key": F.col("conv_id") * 100 + F.col("turn"), "label": F.col("role")}, timestamp=utc(AS_OF),
    )

    def shout(items):
        return items.withColumns({"content": F.upper(F.col("metadata")["label"]), "success": F.lit(True)})

    done = process({"docs": docs, "chat": chat}, shout, accepts=["text"], others="fail")
    meta = F.col("metadata")
    return done.select(
        meta["origin"].alias("origin"), meta["key"].cast("bigint").alias("key"), "success", "content", "error_message"
    )


# --- notes -------------------------------------------------------------------------------------

_NAME = "regexp_replace(url, '[^\\p{L}\\p{N} \\-_]', '_', 'g')"


def page_notes(spark, sf):
    """Pages as items titled by their address, their language as a tag."""
    pages = wide(spark, sf, "pages")
    return make_items(
        pages, content=F.col("html"), source="web", natural_key=F.col("page_id"), timestamp=utc(AS_OF),
        metadata={
            "title": F.concat(F.lit(" "), F.col("url"), F.lit(" é ")), "page_id": F.col("page_id"),
            "short": F.length("html") < 5000, "nothing": F.lit(None).cast("string"),
        },
        tags=F.array(F.lit("page"), F.concat(F.lit("n"), F.length("url").cast("string"))), keep=("page_id",),
    )


@query("note_path", f"SELECT page_id, '2024-01-31_' || replace({_NAME}, ' ', '_') || '_é-web-00-00-00.md' AS path FROM pages")
def note_path(spark, sf):
    name = N.file_name("{date}_{title}-{source}-{time}", F.col("metadata"), F.col("id"), F.col("source"), utc(AS_OF))
    return page_notes(spark, sf).select("page_id", name.alias("path"))


@query("note_template", f"""SELECT page_id, '#  ' || url || ' é ' || {_NL} || html || {_NL} || CAST(page_id AS VARCHAR) || ' None 2024-01-31' AS content FROM pages""")
def note_template(spark, sf):
    text = N.apply_template(
        "# {title}\n{content}\n{page_id} {nothing} {date}", F.col("content"), F.col("metadata"), F.col("id"), F.col("source"), utc(AS_OF)
    )
    return page_notes(spark, sf).select("page_id", text.alias("content"))


_HEAD = f"""'---' || {_NL} || 'title: " ' || url || ' é "' || {_NL} || 'date: 2024-01-31 00:00:00' || {_NL} || 'source: web' || {_NL}
    || 'tags:' || {_NL} || '  - notes' || {_NL} || '  - page' || {_NL} || '  - n' || CAST(length(url) AS VARCHAR) || {_NL}
    || 'short: ' || CASE WHEN length(html) < 5000 THEN 'True' ELSE 'False' END || {_NL}
    || 'page_id: ' || CAST(page_id AS VARCHAR) || {_NL} || '---' || {_NL} || {_NL}"""


@query("note_frontmatter", f"SELECT page_id, {_HEAD} || html AS content FROM pages")
def note_frontmatter(spark, sf):
    head = N.front_matter(F.col("metadata"), F.col("tags"), F.col("source"), utc(AS_OF), ("title", "url", "short"), ("notes",))
    return page_notes(spark, sf).select("page_id", N.with_front_matter(F.col("content"), head).alias("content"))


@query("note_footer", f"""SELECT doc_id, CASE WHEN contains(t, 'Generated on ') THEN t ELSE t || {_NL} || {_NL} || '> Generated on 2024-01-31 00:00:00'
    || {_NL} || {_NL} END AS content FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'Generated on Monday ' || text ELSE text END AS t FROM documents)""")
def note_footer(spark, sf):
    text = F.when(F.col("lang") == "de", F.concat(F.lit("Generated on Monday "), F.col("text"))).otherwise(F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("t"))
    return docs.select("doc_id", N.with_footer(F.col("t"), utc(AS_OF)).alias("content"))


# Notes named by source and language, so that many share a name; names of German sources are taken already.
_WRITES = """SELECT sha256('rss:' || source || chr(31) || CAST(doc_id AS VARCHAR)) AS id, doc_id, 'notes/' || source || '_' || lang AS base,
    lang = 'de' AS taken, text FROM documents"""


def source_notes(spark, sf):
    items = doc_items(spark, sf)
    title = F.concat_ws("_", F.expr("substr(source, 5)"), F.col("metadata")["lang"])
    named = items.withColumn("metadata", F.create_map(F.lit("title"), title))
    options = K.NoteOptions(folder="notes", add_frontmatter=False, add_timestamp=False)
    taken = table(spark, sf, "documents").filter("lang = 'de'").select(
        F.concat(F.lit("notes/"), F.col("source"), F.lit("_de.md")).alias("path"), F.lit(7).cast("bigint").alias("base_length")
    ).distinct()
    return K.render_notes(named, options, AS_OF), taken, options


@query("note_writes", f"""SELECT id, 'create' AS action, base || CASE n + CAST(taken AS INT) WHEN 1 THEN '' WHEN 2 THEN '_20240131000000'
    ELSE '_20240131000000_' || id END || '.md' AS path, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM ({_WRITES}))""")
def note_writes(spark, sf):
    notes, taken, options = source_notes(spark, sf)
    return K.resolve_writes(notes, taken, options, AS_OF).select("id", "action", "path", "content")


@query("note_overwrites", f"""SELECT id, 'overwrite' AS action, base || '.md' AS path, text AS content FROM (SELECT *, row_number() OVER
    (PARTITION BY base ORDER BY id DESC) AS n FROM ({_WRITES})) WHERE n = 1""")
def note_overwrites(spark, sf):
    notes, taken, options = source_notes(spark, sf)
    return K.resolve_writes(notes, taken, replace(options, mode="overwrite"), AS_OF).select("id", "action", "path", "content")


@query("note_appends", f"""SELECT id, 'append' AS action, base || '.md' AS path, CASE WHEN taken THEN CAST(7 AS BIGINT) END AS base_length, text AS content
    FROM ({_WRITES})""")
def note_appends(spark, sf):
    notes, taken, options = source_notes(spark, sf)
    writes = K.resolve_writes(notes, taken, replace(options, mode="append"), AS_OF)
    return writes.select("id", "action", "path", "base_length", "content")


# --- messages out ------------------------------------------------------------------------------


def doc_messages(spark, sf):
    return wide(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


_WRAPPED = f"'From the feeds' || {_NL} || {_NL} || text || {_NL} || {_NL} || 'bye'"


@query("message_truncate", f"""SELECT doc_id AS id, CASE WHEN length(t) > 500 THEN substr(t, 1, 480) || '...' || {_NL} || '[Message truncated]' ELSE t END AS text
    FROM (SELECT doc_id, {_WRAPPED} AS t FROM documents)""")
def message_truncate(spark, sf):
    parts = O.message_parts(doc_messages(spark, sf), max_length=500, prefix="From the feeds", suffix="bye")
    return parts.select("id", "text")


def _break(window: str) -> str:
    def last(needle: str) -> str:
        return f"CASE WHEN contains({window}, {needle}) THEN length({window}) - strpos(reverse({window}), reverse({needle})) - length({needle}) + 1 ELSE 0 END"

    return f"""coalesce(nullif({last(_NL + ' || ' + _NL)}, 0), nullif({last(_NL)}, 0), nullif({last("'. '")}, 0), 2000)"""


_PARTS = f"""WITH RECURSIVE p AS (
    SELECT doc_id AS id, 0 AS n, CAST(NULL AS VARCHAR) AS part, text AS rest FROM documents
    UNION ALL SELECT id, n + 1, CASE WHEN length(rest) <= 2000 THEN rest ELSE substr(rest, 1, b) END,
        CASE WHEN length(rest) <= 2000 THEN '' ELSE ltrim(substr(rest, b + 1), {TRIM}) END
    FROM (SELECT id, n, rest, {_break('substr(rest, 1, 2000)')} AS b FROM p WHERE rest <> '')),
    q AS (SELECT id, n AS part_no, max(n) OVER (PARTITION BY id) AS part_count, part FROM p WHERE n > 0)
    SELECT id, CAST(part_no AS BIGINT) AS part_no, CAST(part_count AS BIGINT) AS part_count,
    CASE WHEN part_count > 1 THEN '[Part ' || CAST(part_no AS VARCHAR) || '/' || CAST(part_count AS VARCHAR) || ']' || {_NL} || {_NL} || part ELSE part END AS text FROM q"""


def _long_counts(parts):
    return parts.withColumns({n: F.col(n).cast("bigint") for n in ("part_no", "part_count")})


@query("message_parts", _PARTS)
def message_parts(spark, sf):
    return _long_counts(O.message_parts(doc_messages(spark, sf), split=True))


@query("outbox", f"SELECT p.*, recipient FROM ({_PARTS}) p CROSS JOIN (VALUES ('r1@example.com'), ('r2@example.com')) AS r(recipient)")
def outbox(spark, sf):
    return _long_counts(O.outbox(doc_messages(spark, sf), RECIPIENTS, split=True))


@query("item_json", """SELECT doc_id, to_json({'id': sha256('rss:' || source || chr(31) || CAST(doc_id AS VARCHAR)), 'content_type': 'text',
    'source': 'rss:' || source, 'timestamp': '2024-01-31T00:00:00', 'execution_time_ms': '0.0', 'tokens_in': NULL}) AS picked, text AS content FROM documents""")
def as_json(spark, sf):
    written = doc_items(spark, sf).select("doc_id", item_json().alias("j"))
    parsed = F.from_json("j", f"{schema.ITEM.replace('timestamp timestamp_ntz', 'timestamp string')}")
    read = written.select("doc_id", parsed.alias("p"), "j")
    picked = F.to_json(
        F.struct(
            F.col("p.id").alias("id"), F.col("p.content_type").alias("content_type"), F.col("p.source").alias("source"),
            F.col("p.timestamp").alias("timestamp"),
            F.get_json_object("j", "$.metrics.execution_time_ms").alias("execution_time_ms"),
            F.get_json_object("j", "$.metrics.tokens_in").alias("tokens_in"),
        ),
        {"ignoreNullFields": "false"},
    )
    return read.select("doc_id", picked.alias("picked"), F.col("p.content").alias("content"))


@query("conformed_results", "SELECT doc_id, text AS content, CAST(NULL AS VARCHAR) AS error_message FROM documents")
def conformed(spark, sf):
    items = doc_items(spark, sf)
    results = conform(items.drop("doc_id"), schema.RESULT)
    key = F.expr("CAST(substr(metadata['title'], 7) AS BIGINT)")
    return results.select(key.alias("doc_id"), "content", "error_message")
