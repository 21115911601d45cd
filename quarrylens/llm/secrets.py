"""Credentials embedded in source code and configuration.

A string is unnatural if a public subword vocabulary needs many tokens for its characters. That score comes first: what a
machine made (a key, a token, a header's or an address's credential) must be unnatural, more so the less the scan itself
trusted the value. Context rules then decide: the variable's name, the names in the excerpt, the call around the value,
its form. Only a password chosen by a person may look natural, and then its name or place must call it one. What is found
is masked in the excerpt character by character, so that every offset, quote and line stays where it was.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.bpe import Bpe, vocabulary, vocabulary_bytes
from quarrylens.session import spread

#: Fewer characters per subword than this make a string unnatural; random letters and digits have about 1.5 to 2.2.
UNNATURAL = 2.5

#: How far a scan's confidence moves that limit: below 0.3 and from 0.7 on.
DOUBTED, TRUSTED = -0.3, 0.3

#: Names of passwords, which people choose and which may therefore look natural.
PASSWORD_WORDS = re.compile(r"pass|pwd?(?:$|_)|pw$|kennwort|zugangsdaten|clave|contrase|mot_?de|senha|wachtwoord|credential|creds?(?:$|_)|secret")
#: Words for secrets in variable names, and words that make such a name mean something else.
SECRET_WORDS = re.compile(
    r"passw(?:or)?d|passwort|passphrase|passwd|(?:^|_)pass(?:$|_)|(?:^|_)pwd?(?:$|_)|rootpw|pw$|pass$|storepass|keypass|secret|token|api_?key|access_?key|auth_?key|private_?key|signing_?key|encryption_?key|hmac_?key|master_?key"
    r"|account_?key|shared_?key|credential|bearer|kennwort|zugangsdaten|schl(?:ü|ue)ssel|clave|contrase(?:ñ|n)a|mot_?de_?passe|motdepasse|senha|wachtwoord|salt$|(?:^|_)creds?(?:$|_)|(?:^|_)key$"
)
OTHER_WORDS = re.compile(
    r"(?:^|_)(?:type|kind|url|uri|scheme|field|label|help|names?|path|file|dir|header|mode|hint|re|regex|regexp|pattern|matcher|ids?|prefix|suffix|length|len|count|ttl|expiry|expires|endpoint|santa|policy|format|template|message|msg|prompt|title|text|error|public|pub|verify"
    r"|example|sample|placeholder|column|param_name|env|var|ref|alias|index|position|limit|size|hash|checksum|digest|fingerprint|algorithm|alg|issuer|audience|scope|location|provider|store_name|question)(?:$|_)|pubkey|tokeniz|passthrough|passenger|bypass|compass|keyword|keyboard|monkey|tokens?_(?:per|used)|doc_"
)
#: What stands for a value that is not there.
PLACEHOLDER_WORDS = re.compile(
    r"change_?me|replace_?(?:me|this|with)|placeholder|insert|your[-_ ]|my[-_]?(?:secret|password|token|key)$|dummy|example|sample|todo|fixme|redacted|not[-_]a[-_]|fake|goes[-_]here|[-_]here$|set[-_]in|set[-_]me|fill[-_]in|to[-_]be|example\.com|^(?:none|null|nil|undefined|empty|secret|password|passwd|token|key|user|pass|test|foo|bar|foobar|admin|root|default|true|false)$|^x+$|access[-_]token>|hunter2$",
    re.I,
)
REFERENCE = re.compile(
    r"^\s*(?:\$\{[^}]*\}|\$\([^)]*\)|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%|%\([^)]*\)s|\{\{.*\}\}|\{[A-Za-z_.]*\}|#\{.*\}|<[^<>]*>|\[[A-Za-z_ -]+\]|@[A-Za-z]+@|!\w+ .*|(?:env|ssm|vault|secretref|secretsmanager|keyvault|kms|arn|ref|file|secret|sops|op|doppler|gcp|aws|azure|akv|conjur|credstash|parameter|configmap|k8s)(?::|://)\S*|\$secret\S*)\s*$"
    r"|^\s*[A-Za-z_][\w.]*\s*[\[(].*[\])]\s*$|^process\.env\.|^os\.environ|^ENV\b",
    re.I,
)

#: Forms that public services give to their credentials.
PREFIXED = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[\w-]{16,}|gl(?:ptt|dt|rt|soat)-[\w-]{16,}|xox[abeoprs]-[\w-]{20,}|xapp-[\w-]{20,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{12,}|sk-(?:proj-|ant-|or-)?[A-Za-z0-9_-]{16,}"
    r"|(?:AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16}(?![0-9A-Z])|AIza[\w-]{30,}|ya29\.[\w-]{20,}|SG\.[\w.-]{20,}|hvs\.[\w-]{20,}|hvb\.[\w-]{20,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}|dop_v1_[0-9a-f]{30,}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{30,}|key-[0-9a-f]{32}|EAAC[A-Za-z0-9]{20,}"
    r"|hf_[A-Za-z0-9]{30,}|rubygems_[0-9a-f]{30,}|dckr_pat_[\w-]{20,}|sq0(?:atp|csp)-[\w-]{20,}|lin_api_[A-Za-z0-9]{30,}|NRAK-[A-Z0-9]{20,}|PMAK-[\w-]{20,}|figd_[\w-]{20,}|dapi[0-9a-f]{32}|tfp_[\w-]{20,}|AGE-SECRET-KEY-[A-Z0-9]{20,}|[a-z]{3,5}[._](?:live|prod|test|k|key|sk|pat|secret)[-_][A-Za-z0-9]{16,})"
)
JWT = re.compile(r"eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{16,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:(?!-----)[\s\S]){40,})(?:-----END [A-Z0-9 ]*-----)?")
#: What no key's body holds: gaps, brackets and masks.
PEM_GAP = re.compile(r"\.{3}|…|[<>\[\]{}*$]|redacted|x{8}", re.I)
URL_LOGIN = re.compile(r"[a-zA-Z][\w+.-]*://[^\s/:@]*:([^\s/@]+(?:@[^\s/@]+(?=@))?)@[\w.\[\]-]+")
URL_PARAM = re.compile(r"[?&;#](?:api[-_]?key|apikey|key|token|access[-_]?token|auth[-_]?token|auth|sig|signature|secret|client[-_]?secret|password|passwd|pwd|pass|code|x-api-key|subscription-key|sas|jwt)=([^&#;\s\"']{8,})", re.I)
URL_PASSWORD = re.compile(r"[?&;#](?:client[-_]?secret|secret|password|passwd|passphrase|pwd|pass)=([^&#;\s\"']{4,})", re.I)
HOOK = re.compile(r"https?://[^\s/]*(?:hook|webhook|discord|chat\.|outlook)[^\s/]*(?:/[\w.-]+)*?/([A-Za-z0-9_-]{8,}/[A-Za-z0-9_-]{12,}|[A-Za-z0-9_-]{20,})", re.I)
HEADER = re.compile(r"(?:^|[\s:\"'=])(Bearer|Basic|Token|ApiKey|Digest|AWS4-HMAC-SHA256|SharedKey|Negotiate)\s+([A-Za-z0-9._~+/=:-]{12,})", re.I)
ASSIGNED = re.compile(
    r"(?:^|[\s;,&?\"'{(:_-])(?:--?)?(?:[a-z]+[-_])?(?:password|passwd|passphrase|pwd|pass|secret|client[-_]?secret|token|access[-_]?token|auth[-_]?token|api[-_]?key|apikey|access[-_]?key|account[-_]?key|sharedaccesskey|shared[-_]?access[-_]?signature|private[-_]?key|secret[-_]?key|x-api-key|key)"
    r"(?:\s*[=:]\s*|(?<=[a-z])\s+(?=\S))[\"']?([^\s;&\"',]{6,})",
    re.I,
)
FLAG = re.compile(r"(?:^|\s)--?(?:password|passwd|passphrase|pwd|pass|secret|client-secret|token|access-token|auth-token|api-key|apikey|key|secret-key|private-key|pw)(?:=|\s+)[\"']?([^\s\"']{6,})|(?:^|\s)(?:-u|--user)(?:=|\s+)[\"']?[^\s:\"']+:([^\s\"']{4,})|(?:^|\s)-p([^\s\"'=-][^\s\"']{5,})", re.I)
LOGIN_CALL = re.compile(r"(?:log_?in|sign_?in|auth(?:enticate|orize)?|set_?(?:password|token|credentials?|api_?key|secret)|credentials?|basic_?auth|use_?token|with_?(?:token|secret|password))\s*\([^()\n]{0,80}$", re.I)

#: The name or key that a value is assigned to, just before the value's quote.
ASSIGNEE = re.compile(r"([^\W\d][\w.-]*)[\"'`]?\s*\]?\)?\s*(?::\s*[\w.<>\[\]?]+\s*=|:=|=>|==?|:)\s*[bruf]{0,2}[\"'`]*$")
#: Names of what proves who asks, secret only if the value is random.
SESSION_WORDS = re.compile(r"(?:^|_)(?:auth|authorization|session|cookie)(?:$|_)")

UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
HARMLESS = re.compile(
    r"^(?:sha(?:1|224|256|384|512)[-:]|md5[-:]|data:|arn:|urn:|ssh-(?:rsa|ed25519|dss)|ecdsa-sha2|-----BEGIN (?:[A-Z0-9 ]*PUBLIC|CERTIFICATE|X509)|/|\./|\.\./|~/|[A-Za-z]:\\)|^(?:https?|ftp|s3|gs|git|ssh|wss?|[a-z]+)://|^[\w.+-]+@[\w-]+(?:\.[\w-]+)+$|^\w[\w./-]*:\d+\.\d+(?:\.\d+)?(?:[-+.][\w.]+)?$"
    r"|^v?\d+(?:\.\d+)+(?:[-+][\w.]+)?$|^\d{4}-\d\d-\d\d"
)
PATTERN = re.compile(r"\[[^\]]*-[^\]]*\](?:[{+*?]|$)|\(\?[a-z:=!]|\\[dwsb]|\[\^|\.\*|\{\d+,?\d*\}|%[-\d.]*[sdfYmHM]|\{\w*\}")


def placeholder(part: str) -> bool:
    """Whether a part stands for a secret kept elsewhere, for none at all, or is only a pattern."""
    core = part.strip().strip("\"'")
    if len(core) < 4 or REFERENCE.search(core) or PLACEHOLDER_WORDS.search(core):
        return True
    letters = re.sub(r"[^A-Za-z0-9]", "", core)
    if len(set(letters)) <= 2 or len(letters) < 0.5 * len(core) and len(letters) < 5:
        return True
    run = max((len(m[0]) for m in re.finditer(r"(.)\1*", core)), default=0)
    if run >= max(6, 0.4 * len(core)):
        return True
    if re.search(r"(?:0123456789|abcdefghij|ABCDEFGHJK|ABCDEFGHIJ|12345678|987654321)", core):
        return True
    return bool(re.search(r"\$\{|\$\(|\{\{|<[a-zA-Z][\w -]*>|\$[A-Z_]{2,}|%[A-Z_]{3,}%", core)) or bool(re.search(r"\[[^\]]*-[^\]]*\]|\\[dwsb]|\{\d+,?\d*\}", core))


def usable_key(body: str) -> bool:
    """Whether a private key's body is all there: no gap, and most of it, piece by piece, no placeholder."""
    core = re.sub(r"\\[nr]|\s", "", re.sub(r"(?:^|(?<=\n)|(?<=\\n))[A-Za-z-]+: [^\n\\]*", "", body))
    pieces = [core[i : i + 60] for i in range(0, len(core), 60) if i == 0 or len(core) - i >= 16]
    return not PEM_GAP.search(core) and 2 * sum(placeholder(x) for x in pieces) < len(pieces)


def name_of(variable: str | None) -> str:
    """A variable's name in lower case with words joined by "_"."""
    return re.sub(r"[^a-z0-9äöüñ]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", variable or "").lower()).strip("_")


def readable(text: str) -> bool:
    """Base64 that spells out ordinary text."""
    try:
        raw = base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False
    return len(raw) > 6 and sum(32 <= b < 127 for b in raw) / len(raw) > 0.95


def unnatural(text: str, confidence: float | None, bpe: Bpe, limit: float = UNNATURAL) -> bool:
    """Whether a string needs more subwords than natural text of its length; an unknown confidence (null, -1) moves nothing."""
    if confidence is not None and confidence >= 0:
        limit += DOUBTED if confidence < 0.3 else TRUSTED if confidence >= 0.7 else 0.0
    return bpe.chars_per_token(text) < limit


def surroundings(value: str, context: str | None) -> tuple[list[str], bool]:
    """Names that ``value`` is assigned to in its excerpt, and whether it is handed to a login call, over all its occurrences."""
    names, called, at = [], False, (context or "").find(value)
    while at >= 0:
        before = context[max(0, at - 100) : at]
        called = called or bool(LOGIN_CALL.search(before))
        if assigned := ASSIGNEE.search(before.rpartition("\n")[2]):
            names.append(name_of(assigned[1]))
        at = context.find(value, at + len(value))
    return names, called


def random_value(text: str, name: str, confidence: float | None, bpe: Bpe) -> bool:
    """Whether a bare value under a name that says nothing is too unnatural to be anything but a credential.

    Hexadecimal digits are as often a checksum and count only under names of sessions; a low score asks for more.
    """
    if OTHER_WORDS.search(name) or UUID.search(text) or PATTERN.search(text) or len(text) < 16 or not re.fullmatch(r"[\x21-\x7e]+", text):
        return False
    if not (re.search(r"\d", text) and re.search(r"[A-Za-z]", text)):
        return False
    if re.fullmatch(r"[0-9a-fA-F]+", text) and not SESSION_WORDS.search(name):
        return False
    if readable(text) or re.fullmatch(r"[a-z]+(?:[-_./:][a-z]+|[-_./:]?\d+)*", text):
        return False
    return unnatural(text, confidence, bpe, UNNATURAL - 0.4)


def secret_parts(value: str | None, variable: str | None, confidence: float | None, context: str | None, bpe: Bpe) -> list[str]:
    """The parts of ``value`` that are usable secrets; none if it holds none."""
    if not value or not value.strip():
        return []
    text = value.strip()
    parts = [m[1].strip("\n") for m in PEM.finditer(text) if usable_key(m[1]) and unnatural(m[1], confidence, bpe)]
    rest = PEM.sub(";", text)
    keyed, text = rest != text, rest
    for pattern in (JWT, PREFIXED):
        parts += [m[0] for m in pattern.finditer(text) if not placeholder(re.sub(r"^[A-Za-z_]+[-_.]", "", m[0])) and unnatural(m[0], confidence, bpe, UNNATURAL + 0.5)]
    for m in URL_LOGIN.finditer(text):
        if not placeholder(m[1]) and not m[1].isupper():
            parts.append(m[1])
    for m in URL_PARAM.finditer(text):
        if not placeholder(m[1]) and unnatural(m[1], confidence, bpe, UNNATURAL + 0.5):
            parts.append(m[1])
    if "://" in text:
        # the name is evidence enough, whatever the value looks like
        parts += [m[1] for m in URL_PASSWORD.finditer(text) if not placeholder(m[1]) and not PATTERN.search(m[1])]
    for m in HOOK.finditer(text):
        if re.search(r"\d", m[1]) and not placeholder(m[1]) and unnatural(m[1], confidence, bpe):
            parts.append(m[1])
    for m in HEADER.finditer(text):
        token = m[2]
        if placeholder(token) or PATTERN.search(text):
            continue
        if unnatural(token, confidence, bpe):
            parts.append(token)
    # an address in front has had its own rules; what follows it is read like any other text
    first = text.split(None, 1)[0]
    plain = text[len(first) :] if "://" in first.split("=")[0] else text
    if not PATTERN.search(plain):
        for m in FLAG.finditer(plain):
            part = m[1] or m[2] or m[3]
            chosen = m[3] is None and (m[2] or re.search(r"pass|pwd|pw|secret", m[0][: m.start(1) - m.start()], re.I))
            if part and not placeholder(part) and (chosen or unnatural(part, confidence, bpe)):
                parts.append(part)
        for m in ASSIGNED.finditer(plain):
            part = m[1]
            joined = re.search(r"[=:]\s*[\"']?$", plain[: m.start(1)])
            chosen = re.search(r"\d|[^\w]", part) and PASSWORD_WORDS.search(name_of(plain[m.start() : m.start(1)]))
            if joined and not placeholder(part) and not HARMLESS.search(part) and (chosen or unnatural(part, confidence, bpe)):
                parts.append(part)
    if parts or keyed:
        return list(dict.fromkeys(parts))

    # a bare value: its score, then what it is called and where it stands
    if placeholder(text) or HARMLESS.search(text) or PATTERN.search(text) and " " in text or "\n" in text:
        return []
    name = name_of(variable)
    assigned, called = surroundings(value, context)
    listed = lambda n: bool(SECRET_WORDS.search(n)) and not OTHER_WORDS.search(n)
    if not listed(name) and not OTHER_WORDS.search(name):
        name = next((n for n in assigned if listed(n)), name or next(iter(assigned), ""))
    made = unnatural(text, confidence, bpe)
    if not (listed(name) or called):
        return [text] if made and random_value(text, name, confidence, bpe) else []
    if not made and not called and not PASSWORD_WORDS.search(name):
        return []
    if UUID.search(text) and not re.search(r"key|token|secret", name):
        return []
    words = text.split()
    if len(words) > 1:
        # a passphrase: a few plain words, no sentence
        plain = len(words) >= 3 and len(words) <= 8 and all(re.fullmatch(r"[a-z]{3,}", w) for w in words)
        spoken = re.search(r"\b(?:is|are|was|were|has|have|will|cannot|must|the|your|a|an|not|be|been|for|with|from|where|to|and|or|of|in|enter|invalid|incorrect|please|forgot)\b", text)
        return [text] if plain and not spoken else []
    if re.fullmatch(r"[a-z]+(?:[_./-][a-z]+)*|[A-Z]+(?:_[A-Z]+)*|[A-Z][a-z]+(?:-[A-Z][a-z]+)*|[a-z]+(?:[A-Z][a-z]+)*", text):
        # words only: a secret if they are no words
        return [text] if len(text) >= 12 and bpe.chars_per_token(text) < UNNATURAL - 0.4 else []
    if PATTERN.search(text) and re.search(r"[{}\[\]()|\\]", text):
        return []
    if re.fullmatch(r"[A-Za-z0-9+/]{20,}={0,2}", text) and readable(text):
        return [] if not called and not re.search(r"pass|secret|key|cred", name) else [text]
    if len(text) < 6:
        return []
    if re.fullmatch(r"\d+(?:\.\d+)?", text):
        return [text] if len(text) >= 6 and re.search(r"pass|pw|pin|secret", name) else []
    return [text]


def masked(context: str | None, parts: list[str], value: str = "") -> str | None:
    """The excerpt with the parts masked, each character by one "*"; line ends and escapes stay.

    A part is masked wherever it stands in the value's own places, and elsewhere only where it isn't a piece of a longer word.
    """
    if context is None or not parts:
        return context
    out = list(context)

    def apart(at: int, end: int) -> bool:
        edge = context[at - 1 : at + 1] if at else "", context[end - 1 : end + 1]
        return not any(len(x) == 2 and re.fullmatch(r"\w\w", x) for x in edge)

    own = [m.span() for m in re.finditer(re.escape(value), context)] if value else []
    own = [x for x in own if apart(*x)] or own
    for part in sorted(parts, key=len, reverse=True):
        at = context.find(part)
        while at >= 0:
            end = at + len(part)
            if not apart(at, end) and not any(a <= at and end <= b for a, b in own):
                at = context.find(part, at + 1)
                continue
            i = at
            while i < end:
                if context[i] in "\r\n":
                    i += 1
                elif context.startswith("\\n", i) and i + 1 < end and "PRIVATE KEY" in context:
                    i += 2
                else:
                    out[i] = "*"
                    i += 1
            at = context.find(part, end)
    return "".join(out)


def credentials(
    values: DataFrame, id_col: str = "value_id", value_col: str = "original_value", name_col: str = "variable_name", score_col: str = "confidence", context_col: str = "context_text", vocabulary_dir: str | None = None
) -> DataFrame:
    """``(id_col, secrets, redacted)`` of every distinct row that holds a usable secret.

    ``secrets`` are the parts found, ``redacted`` the excerpt with them masked and all else unchanged (null if it is
    null). Rows with a null or blank value never come out; null names, scores and excerpts only leave less to go by.
    """
    shared = values.sparkSession.sparkContext.broadcast(vocabulary_bytes(folder=vocabulary_dir))
    rows = values.select(F.col(id_col).alias("id"), F.col(value_col).alias("value"), F.col(name_col).alias("name"), F.col(score_col).cast("double").alias("score"), F.col(context_col).alias("context")).where("value rlike '\\\\S'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(shared.value)
        for batch in batches:
            ids, secrets, redacted = [], [], []
            for i, value, name, score, context in zip(*[c.to_pylist() for c in batch.columns]):
                parts = secret_parts(value, name, score, context, bpe)
                if parts:
                    ids.append(i)
                    secrets.append(parts)
                    redacted.append(masked(context, parts, value.strip()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(secrets, pa.list_(pa.string())), pa.array(redacted, pa.string())], ["id", "secrets", "redacted"])

    kind = values.schema[id_col].dataType.simpleString()
    found = spread(rows).mapInArrow(run, f"id {kind}, secrets array<string>, redacted string")
    return found.distinct().withColumnRenamed("id", id_col)
