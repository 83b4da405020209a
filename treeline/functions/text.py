"""Scalar functions on text, JSON, URLs and secrets, as columns."""

from __future__ import annotations

import hashlib
import json
import math
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as browsers' scripts see it: no-break and other Unicode blanks too.
BLANK = r"[\t\n\x0B\f\r    -     　﻿]"


def collapse(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def excerpt(text: Column, limit: int) -> Column:
    """The text, or its beginning cut at the last blank in the second half, with an ellipsis."""
    head = F.substring(text, 1, limit)
    blank = limit - F.instr(F.reverse(head), " ") + 1
    cut = F.when((F.instr(head, " ") > 0) & (blank * 2 >= limit), F.rtrim(F.substring(text, F.lit(1), (blank - 1).cast("int")))).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


@F.pandas_udf(T.StringType())
def utf16_prefix(texts: pd.Series, limits: pd.Series) -> pd.Series:
    """The first units of UTF-16, never half of a pair."""
    return pd.Series([None if t is None else t.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "ignore") for t, n in zip(texts, limits, strict=True)])


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical(value: object, compact: bool = True) -> str:
    """JSON with sorted keys and without NaN; separators compact or with blanks."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":") if compact else (", ", ": "))


def strict_json(text: str) -> object:
    """Parses JSON and rejects repeated keys, NaN and infinities."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out: dict = {}
        for k, v in items:
            if k in out:
                raise ValueError(f"repeated key {k!r}")
            out[k] = v
        return out

    def constant(name: str) -> object:
        raise ValueError(f"{name} is no JSON")

    def number(text: str) -> float:
        value = float(text)
        if not math.isfinite(value):
            raise ValueError(f"{text} is too large")
        return value

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The canonical form of strict JSON; null for what is none."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical(strict_json(t))
        except ValueError:
            return None

    return texts.map(one)


def resolve_pointer(value: object, pointer: str) -> object:
    """RFC 6901; raises LookupError if the pointer names nothing, ValueError if it is none."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer is empty or starts with a slash")
    for raw in pointer.split("/")[1:]:
        rest = raw.replace("~0", "").replace("~1", "")
        if "~" in rest:
            raise ValueError("a tilde stands before 0 or 1 only")
        step = raw.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict):
            if step not in value:
                raise LookupError(step)
            value = value[step]
        elif isinstance(value, list):
            if not step.isascii() or not step.isdigit() or (len(step) > 1 and step[0] == "0") or int(step) >= len(value):
                raise LookupError(step)
            value = value[int(step)]
        else:
            raise LookupError(step)
    return value


@F.pandas_udf(T.StringType())
def json_pointer(texts: pd.Series, pointers: pd.Series) -> pd.Series:
    """The canonical JSON that the pointer names; null if it names nothing."""

    def one(t: str | None, p: str | None) -> str | None:
        try:
            return None if t is None or p is None else canonical(resolve_pointer(strict_json(t), p))
        except (ValueError, LookupError):
            return None

    return pd.Series([one(t, p) for t, p in zip(texts, pointers, strict=True)])


def pointer_holds(text: str, pointer: str, quote: str) -> bool:
    """Whether what the pointer names is a string that holds the quote."""
    try:
        found = resolve_pointer(strict_json(text), pointer)
    except (ValueError, LookupError):
        return False
    return isinstance(found, str) and bool(quote) and quote in found


def host(url: Column) -> Column:
    """The host in lower case, without a dot at its end."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.+$", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def destination(url: Column) -> Column:
    """Host and path, at most 96 characters; only the scheme of what is no web address."""
    return F.when(F.lower(url).rlike("^https?://"), F.substring(F.concat(host(url), url_path(url)), 1, 96)).otherwise(F.concat(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(":")))


#: What stands in the place of text that must not leave, and patterns of secrets, credentials, local paths, e-mail addresses and URLs.
OMITTED = "[omitted]"
SECRETS = {
    "private key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
    "Google API key": r"AIza[0-9A-Za-z_-]{30,}",
    "Google OAuth access token": r"ya29\.[0-9A-Za-z._~-]{20,}",
    "GitHub token": r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})",
    "provider API key": r"\bsk-(?:proj-|ant-)?[A-Za-z0-9_-]{28,}",
    "AWS access key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "JWT": r"\beyJ[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}",
    "credential-bearing URL": r"[?&](?:access_token|refresh_token|api_key|X-Amz-Signature|X-Goog-Signature)=[A-Za-z0-9%._~-]{20,}",
    "literal authorization header": r"[Bb]earer [A-Za-z0-9._~-]{24,}",
}
CREDENTIAL = r"(?i)(?:password|passwd|secret|(?:access|refresh|session|auth)[_-]?token|api[_-]?key|cookie|authorization)\s*[=:]\s*\S+"
LOCAL_PATH = r"(?:/(?:Users|home|private|tmp|var|opt)/[^\s<>\"']+|[A-Za-z]:\\[^\s]+)"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
URL = r"(?i)(?:https?://|file://|(?:localhost|127\.0\.0\.1)(?::\d+)?/)[^\s<>\"']+"
TOKEN_WORD = r"(?i)(token|session|secret|password|api[_-]?key)"


def safe_url(url: Column, hosts: list[str]) -> Column:
    """The https URL of an allowed host without its fragment, or a fragment alone; empty for all else.

    Users, ports other than 443, addresses in place of hosts, queries, and paths
    that speak of tokens, sessions, secrets, passwords or keys make a URL unsafe.
    """
    authority = F.regexp_extract(url, r"^(?i:https)://([^/?#]*)", 1)
    name = F.lower(F.regexp_extract(authority, r"^([^:@]*)(?::(?:443)?)?$", 1))
    path, query = F.regexp_extract(url, r"^(?i:https)://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    good = (name != "") & name.isin(hosts) & ~name.rlike(r"^[0-9.]+$") & (query == "") & ~path.rlike(TOKEN_WORD)
    return F.when(url.rlike("^#[A-Za-z0-9_-]+$"), url).when(good, F.concat(F.lit("https://"), name, path)).otherwise(F.lit(""))


def has_secret(text: Column) -> Column:
    """Whether a text holds a secret, or assigns a credential."""
    found = text.rlike(CREDENTIAL)
    for pattern in SECRETS.values():
        found = found | text.rlike(pattern)
    return found


def safe_text(text: Column, hosts: list[str]) -> Column:
    """Text that may leave: all of it is omitted if it holds a secret; else local paths and addresses go, then URLs that are not safe. Doing it twice changes nothing more."""
    clean = F.regexp_replace(F.regexp_replace(text, LOCAL_PATH, OMITTED), EMAIL, OMITTED)
    urls = F.transform(F.regexp_extract_all(clean, F.lit(URL), F.lit(0)), lambda u: F.coalesce(F.nullif(safe_url(u, hosts), F.lit("")), F.lit(OMITTED)))
    between = F.split(clean, URL, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(between, F.concat(urls, F.array(F.lit(""))), lambda t, u: F.array(t, u))))
    return F.when(has_secret(text), F.lit(OMITTED)).when(clean.rlike(URL), joined).otherwise(clean)


def private_counts(text: Column) -> dict[str, Column]:
    """How often each kind of private text occurs."""
    return {f"n_{n}": F.regexp_count(text, F.lit(p)) for n, p in (("credential", CREDENTIAL), ("path", LOCAL_PATH), ("email", EMAIL), ("url", URL))}


def masked_session(url: Column) -> Column:
    """A URL without the key of its session."""
    return F.regexp_replace(url, r"/key/[^/?#]+", "/key/SESSION")


def cache_key(*parts: Column) -> Column:
    """Hash that a cached result goes by."""
    return F.sha2(F.concat_ws(":", F.lit("v1"), *parts), 256)


def narration(*parts: Column) -> Column:
    """Sentences of the parts that are not blank."""
    return F.concat_ws(". ", *(F.when(F.trim(p) != "", F.trim(p)) for p in parts))


def generation_cap(prompt_tokens: Column, completion_tokens: Column, max_length: int, max_new: int) -> Column:
    """Tokens that may be generated; null if the wanted answer does not fit."""
    cap = F.least(F.lit(max_new), F.lit(max_length) - prompt_tokens)
    return F.when(cap >= completion_tokens, cap)


def stop_reason(last_is_end: Column, tokens: Column, cap: Column, elapsed: Column, seconds: float) -> Column:
    return F.when(last_is_end, "eos").when(tokens >= cap, "token_limit").when(elapsed >= seconds, "time_limit").otherwise("other")


def strict_label(text: Column) -> Column:
    """A label of 1 to 100 characters with white space collapsed; null for others."""
    label = collapse(text)
    return F.when(F.length(label).between(1, 100), label)


def fits(size: Column, tokens: Column | None, max_bytes: int, max_tokens: int | None = None, reserve: int = 0) -> Column:
    """Whether a prompt of so many bytes and tokens keeps to the limits, with room reserved for an answer."""
    ok = size <= max_bytes
    return ok if max_tokens is None or tokens is None else ok & (tokens + reserve <= max_tokens)


def token_bound(texts: Column) -> Column:
    """A bound on tokens that no tokenizer exceeds: a token a byte, and 1024 for the frame."""
    return F.octet_length(texts) + 1024


def backoff(attempt: Column, retry_after: Column) -> Column:
    """Seconds to wait: 15 doubled with each attempt or what the server asks, 60 at most."""
    return F.least(F.lit(60.0), F.greatest(F.lit(15.0) * F.pow(F.lit(2.0), attempt), F.coalesce(retry_after, F.lit(0.0))))


@F.pandas_udf(T.StringType())
def template_signature(pages: pd.Series) -> pd.Series:
    """Hash of a page's start and end tags in source order, with class, role and type of each: not of its text."""
    return pages.map(lambda html: hashlib.sha256(canonical(tag_stream(html or "")).encode()).hexdigest())


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        self.found.append(["start", tag, [[k, given[k]] for k in ("class", "role", "type") if k in given]])

    def handle_endtag(self, tag: str) -> None:
        self.found.append(["end", tag])


def tag_stream(html: str) -> list[list]:
    tags = _Tags()
    tags.feed(html)
    return tags.found
