"""Text functions as column expressions: tokens, hashes, symbols, salience, retention, cursors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: An edge of a word of ASCII letters, digits and underscores; the engine's own ``\b`` takes letters of any script for word characters.
EDGE = r"(?:(?-iu:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])))"


def edged(pattern: str) -> str:
    """A pattern whose word edges are those of ASCII words, wherever it runs."""
    return pattern.replace(r"\b", EDGE)


# Fixed patterns of the salience families, with what each adds.
SALIENCE = {
    "error": (r"(?i)traceback|error:|\bfailed\b|\bexception\b", 0.25),
    "decision": (r"(?i)\bdecided\b|let'?s go with|\binstead of\b|switched to", 0.2),
    "correction": (r"(?i)\bno,|\bactually\b|that'?s wrong|\bdon'?t\b", 0.2),
    "preference": (r"(?i)i prefer|i always|i never|my name is|i work|call me", 0.3),
    "remember": (r"(?i)\bremember\b|note that|don'?t forget", 0.35),
}
# Fixed patterns of code symbols: pattern, group, least length.
SYMBOLS = (
    (r"`([a-zA-Z_][a-zA-Z0-9_]*(?:\([^)]*\))?)`", 2),
    (r"\b([A-Z][a-z]+(?:[A-Z][a-z0-9]*)+)\b", 3),
    (r"\b([a-z]+(?:[A-Z][a-z0-9]*)+)\b", 3),
    (r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b", 3),
    (r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b", 3),
    (r"\.([a-zA-Z_][a-zA-Z0-9_]*)", 2),
)
# Fixed list of words that look like symbols but are prose.
PROSE = (
    "e_g", "i_e", "the", "and", "for", "not", "with", "this", "that", "self", "init", "com", "org", "www", "http", "https",
    "png", "jpg", "md", "txt", "py", "js", "ts",
)
MAX_SYMBOLS = 64
# Fixed patterns of retention.
NARRATION = (
    r"(?i)\b(?:created|made|pushed|amended|rebased|squashed)\s+(?:the\s+)?commit\b|\bcommit\s+[0-9a-f]{7,40}\b"
    r"|\b(?:ran|running|executed)\s+(?:the\s+)?(?:tests?|pytest|ruff|lint|build)\b|\b(?:command|process)\s+(?:completed|exited|returned)\b"
)
OPERATIONAL = r"(?i)\b(?:branch|deployment|deploy(?:ment|ed|ing|s)?|pull request|pr\s*#?\d+|ci|currently working on|working on)\b"
END_DATE = r"(?i)\b(?:until|through|ending|ends|expires|expiry|end date(?: is)?)\s+(\d{4}-\d{2}-\d{2})\b"
DURABLE_KINDS = ("preference", "warning", "profile", "decision")
#: Fixed intent families; the first that scores best wins.
INTENTS = {
    "temporal": (
        r"(?i)\b(when|last|yesterday|today|tomorrow|ago|before|after|since|until|during|recently|lately)\b",
        r"(?i)\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
        r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\b",
        r"\b\d{4}-\d{2}-\d{2}\b",
        r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
        r"(?i)\b(this|next|last)\s+(week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
        r"(?i)\b\d+\s+(day|week|month|year|hour|minute)s?\s+(ago|from now|later|earlier)\b",
    ),
    "factual": (
        r"(?i)\bwhat\s+is\b", r"(?i)\bwho\s+is\b", r"(?i)\bwhere\s+is\b",
        r"(?i)\b(definition|define|explain|meaning)\b", r"(?i)\bhow\s+(many|much|long|far)\b",
    ),
    "entity": (
        r"(?i)\b(tell\s+me\s+about|what\s+do\s+you\s+know\s+about)\b", r"(?i)\b(who\s+is|what\s+does)\s+[a-z]+\b",
        r"(?i)\b(about|regarding|concerning)\s+[a-z]+\b",
    ),
    "preference": (
        r"(?i)\b(prefer|like|dislike|want|hate|love|enjoy|favorite|best|worst)\b",
        r"(?i)\b(should\s+i|would\s+you|do\s+you\s+recommend)\b", r"(?i)\b(choose|pick|select|option|choice|decide)\b",
    ),
    "procedural": (
        r"(?i)\bhow\s+(to|do|can|should|would)\b", r"(?i)\b(step|process|procedure|workflow|guide|tutorial)\b",
        r"(?i)\b(setup|install|configure|build|deploy|run|execute|start|stop)\b",
    ),
}
#: Fixed multipliers of the keyword and vector legs by intent.
INTENT_LEGS = {
    "temporal": (1.5, 0.6), "factual": (1.2, 1.0), "entity": (1.0, 1.1), "preference": (0.8, 0.9), "procedural": (0.9, 1.3),
    "general": (1.0, 1.0),
}
#: Fixed marks of an answer that abstains.
ABSTENTION = (
    "i don't know", "i do not know", "dont know", "don't have", "cannot determine", "can't determine", "could not determine",
    "no evidence", "not enough", "insufficient", "unable to", "no information", "no record", "nothing in memory", "unknown",
)
#: Fixed patterns of text that reads like an instruction: of what a tool is told, and of imports.
INSTRUCTION = (
    r"(?is)\b(ignore|disregard|override|bypass)\b.{0,40}\b(instruction|instructions|rule|rules|policy|policies|prompt|guardrail)"
    r"|\bfrom now on\b|\byou (must|should|will) (always|never)\b|\bsystem prompt\b|\balways (approve|allow|run|execute|trust)\b"
)
IMPORTED_INSTRUCTION = (
    r"(?i)\b(?:ignore|disregard|forget|override)\b.{0,40}\b(?:previous|prior|all|above|earlier)\b.{0,40}\b(?:instructions?|rules?|prompts?|memor(?:y|ies))\b"
    r"|\byou\s+(?:must|should|will)\s+(?:always|never)\b|\bsystem\s+prompt\b|\bfrom\s+now\s+on\b"
)
#: Fixed verbs of a task.
TASK_VERBS = (
    "add", "build", "change", "check", "clean", "configure", "connect", "create", "debug", "delete", "deploy", "diagnose", "edit",
    "enable", "disable", "fix", "generate", "implement", "import", "install", "integrate", "make", "migrate", "move", "optimize",
    "patch", "publish", "refactor", "release", "remove", "rename", "replace", "resolve", "run", "set", "setup", "ship", "test",
    "update", "upgrade", "write",
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _folded(text: Column) -> Column:
    """NFC, full case folding and white space of all scripts, for texts that are not ASCII; Spark has no
    function for the first two, so these texts pass through one Arrow batch function."""
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()))

    return fold(text)


def normalised(text: Column) -> Column:
    """Canonical composition, folded case, white space collapsed and trimmed: what content hashes are taken of.

    ASCII texts stay in the JVM; the others are folded in Arrow batches."""
    plain = ~text.rlike(r"[^\x00-\x7f]")
    own = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "), r"^ | $", "")
    return F.when(plain, own).otherwise(_folded(F.when(~plain, text)))


def content_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def canonical_entity(name: Column) -> Column:
    return F.substring(normalised(name), 1, 120)


def clip(text: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def code_symbols(text: Column) -> Column:
    """Likely code identifiers, sorted, at most ``MAX_SYMBOLS``."""
    found = None
    for i, (pattern, least) in enumerate(SYMBOLS):
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if i == 0:
            hits = F.transform(hits, lambda s: F.regexp_replace(s, r"\([^)]*\)", ""))
        else:
            hits = F.filter(hits, lambda s: ~F.lower(s).isin(*PROSE))
        hits = F.filter(hits, lambda s: F.length(s) >= least)
        found = hits if found is None else F.array_union(found, hits)
    return F.slice(F.array_sort(found), 1, MAX_SYMBOLS)


def symbols_field(text: Column) -> Column:
    """Each symbol in lower case and, if it has parts, its parts."""
    split = lambda s: F.lower(F.replace(F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")))
    both = lambda s: F.when(split(s) == F.lower(s), F.lower(s)).otherwise(F.concat_ws(" ", F.lower(s), split(s)))
    return F.array_join(F.array_distinct(F.transform(code_symbols(text), both)), " ")


def salience(user: Column, assistant: Column) -> Column:
    """0..1: how much a turn is worth extracting; short turns without any signal count least."""
    both = F.concat_ws("\n", F.coalesce(user, F.lit("")), F.coalesce(assistant, F.lit("")))
    boost = F.lit(0.0)
    for name, (pattern, add) in SALIENCE.items():
        where = F.coalesce(user, F.lit("")) if name in ("correction", "preference") else both
        boost = boost + F.when(where.rlike(pattern), add).otherwise(0.0)
    boost = boost + F.when(both.contains("```") | (F.size(code_symbols(both)) >= 3), 0.1).otherwise(0.0)
    short = (boost == 0) & (F.length(F.regexp_replace(both, r"^\s+|\s+$", "")) <= 40)
    return F.when(short, 0.05).otherwise(F.least(F.lit(1.0), boost + 0.1))


def retention(content: Column, kind: Column, now: Column) -> Column:
    """struct(retention, ttl_days, source): narration stays an episode, dated and operational rows expire."""
    text = F.trim(F.regexp_replace(content, r"\s+", " "))
    end = F.try_to_date(F.nullif(F.regexp_extract(text, END_DATE, 1), F.lit("")), "yyyy-MM-dd")
    days = F.greatest(F.lit(1), F.least(F.lit(365), F.datediff(end, F.to_date(now)) + 1))
    out = lambda name, n, why: F.struct(F.lit(name).alias("retention"), n.cast("int").alias("ttl_days"), F.lit(why).alias("source"))
    none = F.lit(None)
    return (
        F.when(text.rlike(NARRATION), out("episode_only", none, None))
        .when(end.isNotNull(), out("temporary", days, "explicit_end_date"))
        .when(kind.isin(*DURABLE_KINDS), out("durable", none, None))
        .when(text.rlike(OPERATIONAL), out("temporary", F.lit(7), "operational_default"))
        .otherwise(out("durable", none, None))
    )


def intent(query: Column) -> Column:
    """The family with the best score min(0.3 + 0.15 matches, 1), the first of equals; else general."""
    best, score = F.lit("general"), F.lit(0.0)
    for name, patterns in INTENTS.items():
        hits = sum((F.regexp_count(query, F.lit(p)) for p in patterns), F.lit(0))
        own = F.when(hits > 0, F.least(F.lit(1.0), hits * 0.15 + 0.3)).otherwise(0.0)
        best, score = F.when(own > score, name).otherwise(best), F.greatest(own, score)
    return best


def task_like(query: Column, verbs: tuple[str, ...] = TASK_VERBS) -> Column:
    """An imperative verb among the first four words, but not as the last word."""
    words = F.regexp_extract_all(F.lower(query), F.lit("[a-z]+"), F.lit(0))
    first = F.slice(words, F.lit(1), F.least(F.lit(4), F.greatest(F.size(words) - 1, F.lit(0))))
    return F.exists(first, lambda w: w.isin(*verbs))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def cursor(ts: Column, event_id: Column) -> Column:
    """An opaque paging cursor."""
    return F.base64(F.encode(F.concat_ws("|", ts.cast("string"), event_id.cast("string")), "UTF-8"))


def read_cursor(cursor: Column) -> Column:
    """struct(ts, event_id); empty strings where the cursor can't be read."""
    plain = F.coalesce(F.decode(F.try_to_binary(cursor, F.lit("base64")), "UTF-8"), F.lit(""))
    return F.struct(F.split_part(plain, F.lit("|"), F.lit(1)).alias("ts"), F.split_part(plain, F.lit("|"), F.lit(2)).alias("event_id"))


def topic_filename(tag: Column) -> Column:
    """The file of a topic; tags without a usable character share one."""
    name = F.regexp_replace(F.regexp_replace(tag, r"[^A-Za-z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.concat(F.when(name == "", "untagged").otherwise(name), F.lit(".md"))


def skill_slug(name: Column) -> Column:
    """A skill's folder name, at most 40 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", ""), 1, 40)


def tag_list(raw: Column) -> Column:
    """Tags from a JSON list or from comma-separated text; junk gives what its commas separate."""
    parsed = F.from_json(raw, "array<string>")
    cut = F.filter(F.transform(F.split(raw, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.array().cast("array<string>")).when(
        F.trim(raw).startswith("[") & (F.size(F.coalesce(parsed, F.array().cast("array<string>"))) > 0), parsed
    ).otherwise(cut)


def flattened_parts(raw: Column) -> Column:
    """Message content that may be JSON behind a marker, as text: texts in lines, ``[image]`` for other parts; of what
    is no JSON the first 4000 characters."""
    body = F.substring(raw, 7, 2**31 - 1)
    whole = F.try_parse_json(body)
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    parts = F.coalesce(get(whole, "$", "array<variant>"), F.array(whole))
    said = F.transform(
        parts,
        lambda p: F.when(F.schema_of_variant(p) == "STRING", get(p, "$", "string"))
        .when(get(p, "$.type", "string") == "text", F.coalesce(get(p, "$.text", "string"), F.lit("")))
        .when(F.schema_of_variant(p).startswith("OBJECT"), F.lit("[image]")),
    )
    joined = F.regexp_replace(F.array_join(F.filter(said, lambda t: t != ""), "\n"), r"^\s+|\s+$", "")
    return F.when(raw.startswith("\x00json:"), F.when(whole.isNull(), F.substring(body, 1, 4000)).otherwise(joined)).otherwise(raw)


def abstains(answer: Column) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in ABSTENTION]), lambda m: F.contains(F.lower(answer), m))


def instruction_shaped(text: Column, imported: bool = False) -> Column:
    """Text that reads like an instruction to the model rather than a memory."""
    return text.rlike(IMPORTED_INSTRUCTION if imported else INSTRUCTION)


#: Fixed alphabet of sortable ids.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
#: Fixed model-name prefixes and the provider that each is billed by.
PROVIDERS = {
    "claude": "anthropic", "gpt": "openai", "o1": "openai", "o3": "openai", "o4": "openai", "chatgpt": "openai",
    "gemini": "google", "deepseek": "deepseek",
}


def sortable_id(at: Column, key: Column) -> Column:
    """26 characters that sort by time, with a tail from a hash of ``key``: the same row always gets the same id."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    base32 = lambda number, radix: F.translate(F.conv(number, radix, 32), digits, BASE32)
    tail = F.sha2(key.cast("string"), 256)
    parts = [F.lpad(base32(F.substring(tail, 1 + 10 * i, 10), 16), 8, "0") for i in range(2)]
    return F.concat(F.lpad(base32(F.unix_millis(at).cast("string"), 10), 10, "0"), *parts)


def archive_ref(ref: Column) -> Column:
    """struct(file, uid) of ``file:uid``; null for anything else, such as a file in another folder."""
    part = lambda i: F.regexp_extract(ref, r"^(.*):([^:]*)$", i)
    fine = F.contains(ref, F.lit(":")) & ~part(1).rlike(r"[/\\]|\.\.")
    return F.when(fine, F.struct(part(1).alias("file"), part(2).alias("uid")))


def without_id_prefix(line: Column) -> Column:
    """A rendered line without its ``[id]``."""
    return F.regexp_replace(line, r"(?s)^\[[\p{L}\p{N}]+\]\s*(.*?)\s*$", "$1")


def frontmatter(document: Column) -> Column:
    """The ``key: value`` lines between the dashes at the head of a document, as a map, quotes taken off; empty
    without a head. Of equal keys the last one stands."""
    cut = F.split(document, r"\r?\n")
    lines = F.slice(cut, F.lit(2), F.size(cut))
    end = F.array_position(F.transform(lines, lambda x: F.trim(x)), "---")
    head = F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines)
    bare = lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), r'^"+|"+$', ""), r"^'+|'+$", "")
    pairs = F.transform(
        F.filter(head, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), bare(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")),
    )
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.when(document.startswith("---"), last).otherwise(none))


def replaced_section(document: Column, heading: str, body: str) -> Column:
    """A document in which the text below ``## heading``, up to the next such heading, is ``body``."""
    import re

    pattern = rf"(?sm)^(## {re.escape(heading)}\n).*?(?=^## |\z)"
    return F.regexp_replace(document, pattern, "$1" + body.replace("\\", "\\\\").replace("$", "\\$") + "\n")


def search_aids(aids: Column, content: Column, limit: int = 4) -> Column:
    """Cleaned search aids: 2 to 80 characters, not the content itself, each once whatever its case, at most ``limit``."""
    clean = F.filter(F.transform(aids, lambda a: F.trim(F.regexp_replace(a, r"\s+", " "))), lambda a: F.length(a).between(2, 80))
    clean = F.filter(clean, lambda a: F.lower(a) != F.lower(content))
    low = F.transform(clean, lambda a: F.lower(a))
    return F.slice(F.filter(clean, lambda a, i: F.array_position(low, F.lower(a)) == i + 1), 1, limit)


def metadata(raw: Column) -> Column:
    """A JSON object as a map of strings; junk and other JSON give an empty map."""
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    return F.when(F.trim(raw).startswith("{"), F.coalesce(F.from_json(raw, "map<string,string>"), empty)).otherwise(empty)


def billed_by(model: Column) -> Column:
    """The provider of a bare model name; null for names that say a vendor themselves, and unknown ones."""
    name, out = F.lower(F.trim(model)), None
    for prefix, provider in PROVIDERS.items():
        hit = name.startswith(prefix) & ~name.contains("/")
        out = F.when(hit, provider) if out is None else out.when(hit, provider)
    return out


def json_span(answer: Column) -> Column:
    """The first JSON list or object of an answer: of what a fence holds if that has one, else of the whole. A
    span begins at a bracket and ends where its brackets are even, strings aside; spans that are no JSON are
    passed over, and null is given if none is left."""
    def closing(body: str, start: int) -> int:
        """Where the bracket at ``start`` closes, or 0."""
        open_, quoted, skip = 0, False, False
        for i in range(start, len(body)):
            c = body[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "[{":
                open_ += 1
            elif c in "]}":
                open_ -= 1
                if not open_:
                    return i + 1
        return 0

    def span(answer: str) -> str | None:
        import json
        import re

        for body in (*re.findall(r"```(?:json)?\s*(.*?)```", answer, re.DOTALL), answer):
            for start in (i for i, c in enumerate(body) if c in "[{"):
                end = closing(body, start)
                if end:
                    try:
                        json.loads(body[start:end])
                        return body[start:end]
                    except ValueError:
                        pass
        return None

    @F.pandas_udf("string")
    def first_span(answers: pd.Series) -> pd.Series:
        return answers.map(lambda t: None if t is None else span(t))

    return first_span(answer)


def iso(at: Column) -> Column:
    """A time as text in UTC, in milliseconds; null for null."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_of(text: Column) -> Column:
    """Seconds of a time given as text, milliseconds cut off; null for what is no time."""
    return F.unix_timestamp(F.try_to_timestamp(text))


def import_iso(raw: Column) -> Column:
    """The time of an import as text in UTC; null, which keeps the time of the import, where it has no known form."""
    text = F.trim(raw)
    at = lambda i: F.substring(text, i + 1, 1)
    long = (F.length(text) >= 19) & (at(4) == "-") & at(10).isin(" ", "T")
    return (
        F.when(F.contains(text, F.lit("T")) & text.endswith("Z"), text)
        .when(long, F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit(".000Z")))
        .when((F.length(text) == 10) & (at(4) == "-"), F.concat(text, F.lit("T00:00:00.000Z")))
    )


def later(at: Column, *, days: float = 0, hours: float = 0, seconds: float = 0) -> Column:
    """A time moved on."""
    return F.timestamp_micros(F.unix_micros(at) + F.lit(int((days * 86400 + hours * 3600 + seconds) * 1_000_000)))


def virtual_path(raw: Column) -> Column:
    """struct(view, tag) of a path below ``/memories``: root, profile, index, topics, or one topic with its tag; null for
    all others, such as a path that climbs."""
    cut = F.split(F.replace(F.trim(raw), F.lit("\\"), F.lit("/")), "/")
    parts = F.filter(cut, lambda p: ~p.isin("", "."))
    n, part = F.size(parts), lambda i: F.get(parts, F.lit(i))
    tag = F.lower(F.trim(F.regexp_replace(part(2), r"\.md$", "")))
    topic = (n == 3) & (part(1) == "topics") & part(2).endswith(".md") & (tag != "")
    view = (
        F.when(n == 1, "root")
        .when((n == 2) & (part(1) == "profile.md"), "profile")
        .when((n == 2) & (part(1) == "index.md"), "index")
        .when((n == 2) & (part(1) == "topics"), "topics")
        .when(topic, "topic")
    )
    inside = (part(0) == "memories") & ~F.array_contains(cut, "..")
    return F.when(inside & view.isNotNull(), F.struct(view.alias("view"), F.when(topic, tag).otherwise("").alias("tag")))
