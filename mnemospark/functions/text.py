"""Column builders for text: cleaning, terms, fingerprints, redaction and normalisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Validity states of a record.
VALIDITY = ("active", "superseded", "expired", "archived", "deleted", "quarantined")
# Levels of sensitivity.
SENSITIVITY = ("public", "internal", "private", "restricted")
# Half-life in days by durability.
DURABILITY_DAYS = {"ephemeral": 1.0, "short": 14.0, "normal": 120.0, "durable": 730.0, "pinned": None}
# Fixed value: prefix of scoped keys.
KEY_PREFIX = "mav2"
# Memory types of the same durability.
DURABLE_TYPES = {
    "pinned": ("manual_memory", "explicit_memory"),
    "durable": ("user_profile", "user_preference", "relationship_claim", "promise", "open_loop", "creative_work"),
    "short": ("emotion_state", "current_state", "schedule_fragment", "bot_detail_fragment", "proactive_message"),
    "ephemeral": ("raw_event", "timeline_event"),
}
# What stands for a masked secret, and the names whose values are secret.
MASK = "[REDACTED]"
SECRET_NAMES = ("password", "passwd", "api_key", "apikey", "access_token", "refresh_token", "authorization", "client_secret", "private_key", "credential", "credentials")
# The parts of a session key that name its scope, in the order in which they are looked for; after the first kind stands the target, after the second it is the key's last part.
SCOPE_MARKS = ((":groupmessage:", "group", True), (":group:", "group", False), (":friendmessage:", "private", True), (":privatemessage:", "private", True), (":friend:", "private", False), (":private:", "private", False))
CJK = "一-鿿"


def clean_text(text: Column, limit: int = 2000) -> Column:
    """White space collapsed and stripped; a text above ``limit`` is cut to it, its last character an ellipsis. Null becomes ''."""
    flat = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\s　]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, max(0, limit - 1))), F.lit("…"))).otherwise(flat)


def clamp(value: Column, low: float = 0.0, high: float = 1.0, default: float = 0.0) -> Column:
    """A number held inside [low, high]; what is no number becomes ``default`` first."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.cast("string").try_cast("double"), F.lit(default))))


def stable_fingerprint(*parts: Column) -> Column:
    """SHA-1 of the cleaned lower-cased parts joined by '|'; null parts are skipped."""
    return F.sha1(F.concat_ws("|", *[F.when(p.isNotNull(), F.lower(clean_text(p, 1000))) for p in parts]))


def _digest(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[F.when(p.isNotNull(), F.lower(clean_text(p, 2000))) for p in parts]))


def scoped_key(domain: list[Column], semantic: list[Column], seed: Column | None = None) -> Column:
    """Key of a record in its owner's domain; a seed that is such a key already lends its semantic half."""
    half = _digest(*semantic)
    if seed is not None:
        held = F.regexp_extract(F.lower(seed), rf"^{KEY_PREFIX}:[0-9a-f]{{24}}:([0-9a-f]{{40}})$", 1)
        half = F.when(held != "", held).otherwise(half)
    return F.concat_ws(":", F.lit(KEY_PREFIX), F.substring(_digest(F.lit("domain"), *domain), 1, 24), half)


def cjk_bigrams(text: Column, limit: int = 512) -> Column:
    """The first ``limit`` distinct pairs of adjacent ideographs, in order of appearance."""
    runs = F.regexp_extract_all(text, F.lit(f"([{CJK}]{{2,}})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))
    return F.slice(F.array_distinct(pairs), 1, limit)


def query_terms(text: Column, limit: int = 24) -> Column:
    """Distinct lower-cased search terms: words of letters, digits and '_' from two characters on, and ideograph runs, long ones also as pairs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"([a-z0-9_]+|[{CJK}]{{2,}})"), 1)
    spread = lambda w: F.when(
        w.rlike(f"^[{CJK}]{{4,}}$"), F.concat(F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, 2)), F.array(w))
    ).otherwise(F.array(w))
    return F.slice(F.array_distinct(F.filter(F.flatten(F.transform(words, spread)), lambda t: F.length(t) >= 2)), 1, limit)


def count_of(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of ``part`` in ``text``."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("bigint")).otherwise(0)


def redact_secrets(text: Column) -> Column:
    """Private keys, bearer tokens, passwords in addresses and assigned secrets, quoted or not, masked. Null stays null."""
    masked = MASK.replace("$", r"\$")
    out = F.regexp_replace(text, r"(?is)-----BEGIN [^-\r\n]+ PRIVATE KEY-----.*?-----END [^-\r\n]+ PRIVATE KEY-----", masked)
    out = F.regexp_replace(out, r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}", f"Bearer {masked}")
    out = F.regexp_replace(out, r"(?i)(https?://[^:/\s]+:)[^@/\s]+(@)", f"$1{masked}$2")
    name = r"password|passwd|api[_-]?key|access[_-]?token|refresh[_-]?token|authorization|client[_-]?secret|private[_-]?key"
    return F.regexp_replace(out, rf"""(?i)\b({name})\b(\s*[:=]\s*)(?:"[^"\r\n]*"|'[^'\r\n]*'|[^\s,;\r\n]+)""", f"$1$2{masked}")


def secret_name(name: Column) -> Column:
    """Whether the value under a name is secret: one of ``SECRET_NAMES``, or a name that ends in '_' and one of them."""
    plain = F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_"))
    tails = [plain.endswith(f"_{n}") for n in SECRET_NAMES if n != "apikey"]
    found = plain.isin(*SECRET_NAMES)
    for t in tails:
        found = found | t
    return found


def redact_fields(json: Column) -> Column:
    """A flat JSON object with the values of secret names masked and its texts redacted; null, or what is no object, stays as it is."""
    parsed = F.from_json(json, "map<string,string>")
    clean = F.transform_values(parsed, lambda k, v: F.when(secret_name(k), F.lit(MASK)).otherwise(redact_secrets(v)))
    return F.when(parsed.isNull(), json).otherwise(F.to_json(clean))


def known_or(value: Column, known: tuple[str, ...], fallback: str, empty: str | None = None) -> Column:
    """A trimmed lower-cased value of the vocabulary; an unknown one becomes ``fallback``, null or '' becomes ``empty`` (without it ``fallback`` too)."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*known), low).when(low.isNull() | (low == ""), fallback if empty is None else empty).otherwise(fallback)


def validity_status(value: Column) -> Column:
    return known_or(value, VALIDITY, "quarantined", "active")


def sensitivity(value: Column) -> Column:
    return known_or(value, SENSITIVITY, "restricted", "private")


def durability_of_type(memory_type: Column, fallback: Column) -> Column:
    """Durability that a memory type implies, else ``fallback`` if it is a durability, else normal."""
    kind, held = F.lower(clean_text(memory_type, 80)), F.lower(F.trim(fallback))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for level, types in DURABLE_TYPES.items():
        out = out.when(kind.isin(*types), level)
    return out.when(held.isin(*DURABILITY_DAYS), held).otherwise("normal")


def session_scope(session: Column) -> Column:
    """struct(scope, target) read from a session key such as platform:GroupMessage:id; unknown and '' without a mark of a scope. Null counts as ''."""
    key = F.coalesce(session, F.lit(""))
    low = F.lower(key)
    scope, target = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for mark, name, after in SCOPE_MARKS:
        scope = scope.when(low.contains(mark), name)
        # The last mark counts: what follows it in the key as it was written.
        rest = F.substring_index(low, mark, -1) if after else F.substring_index(low, ":", -1)
        target = target.when(low.contains(mark), F.right(key, F.length(rest)))
    return F.struct(scope.otherwise("unknown").alias("scope"), target.otherwise("").alias("target"))


def half_life_days(durability: Column) -> Column:
    """Half-life of a durability in days; null where nothing decays. Unknown ones count as normal."""
    out = F.when(durability == "pinned", F.lit(None).cast("double"))
    for name, days in DURABILITY_DAYS.items():
        if days is not None:
            out = out.when(durability == name, F.lit(days))
    return out.otherwise(F.lit(DURABILITY_DAYS["normal"]))


def embedding_text(content: Column, evidence: Column, kind: Column, limit: int = 1200) -> Column:
    """The text of a record that is embedded, and whose hash tells stale vectors."""
    return clean_text(F.concat_ws("\n", F.nullif(kind, F.lit("")), F.nullif(content, F.lit("")), F.nullif(evidence, F.lit(""))), limit)
