"""Expressions over hostname-like artifacts. All are Catalyst expressions; only rows that need Unicode
normalization or IDNA pass through an Arrow function, see `normalized`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\x1c-\x1f]"


def ustrip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"(?U)^{WHITE}+|{WHITE}+$", "")


def labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def is_valid(host: Column) -> Column:
    """1 to 253 characters, in labels of 1 to 63; null is not valid."""
    fits = F.forall(labels(host), lambda x: F.char_length(x).between(1, 63))
    return F.coalesce(F.char_length(host).between(1, 253) & fits, F.lit(False))


def label_count(host: Column) -> Column:
    return F.size(labels(host))


def is_ipv4_like(value: Column) -> Column:
    return value.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")


def segmented(value: Column) -> Column:
    """host and what surrounded it: scheme, and whether authority, userinfo, port, path, query, fragment and brackets were there."""
    text = ustrip(F.coalesce(value, F.lit("")))
    url = text.contains("://")
    # RFC 3986, appendix B
    part = lambda i: F.regexp_extract(text, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", i)
    before = lambda c, sep: F.substring_index(c, sep, 1)
    no_fragment = before(text, "#")
    no_query = before(no_fragment, "?")
    bare = before(no_query, "/")
    host = F.when(url, F.when(part(2) != "", part(2)).otherwise(part(3))).otherwise(bare)
    user = host.contains("@")
    host = F.when(user, F.substring_index(host, "@", -1)).otherwise(host)
    bracket = host.startswith("[") & host.contains("]")
    inside = F.regexp_extract(host, r"^\[([^\]]*)\]", 1)
    suffix = F.regexp_extract(host, r"^\[[^\]]*\](.*)$", 1)
    colons = F.char_length(host) - F.char_length(F.replace(host, F.lit(":"), F.lit("")))
    port = F.when(bracket, suffix.startswith(":") & (F.char_length(suffix) > 1)).otherwise(colons == 1)
    host = F.when(bracket, inside).when(colons == 1, before(host, ":")).otherwise(host)
    return F.struct(
        F.regexp_replace(host, r"^[\[\]]+|[\[\]]+$", "").alias("host"),
        F.when(url & (part(1) != ""), F.lower(part(1))).alias("scheme"),
        (url & (part(2) != "")).alias("authority_present"),
        user.alias("userinfo_present"),
        port.alias("port_present"),
        F.when(url, ~part(3).isin("", "/")).otherwise(no_query.contains("/")).alias("path_present"),
        F.when(url, part(4) != "").otherwise(no_fragment.contains("?")).alias("query_present"),
        F.when(url, part(5) != "").otherwise(text.contains("#")).alias("fragment_present"),
        bracket.alias("bracketed_ipv6"),
    )


def _percent_decoded(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        j = i
        raw = bytearray()
        while text[j : j + 1] == "%" and len(text) >= j + 3 and all(c in "0123456789abcdefABCDEF" for c in text[j + 1 : j + 3]):
            raw.append(int(text[j + 1 : j + 3], 16))
            j += 3
        if not raw:
            out.append(text[i])
            i += 1
            continue
        try:
            out.append(raw.decode("utf-8"))
        except UnicodeDecodeError:
            out.append(raw.decode("latin-1"))
        i = j
    return "".join(out)


def _idna(host: str) -> tuple[str, str | None]:
    """The round trip through ASCII, and which library made it."""
    try:
        import idna
    except ImportError:
        idna = None
    if idna:
        try:
            return idna.decode(idna.encode(host, uts46=True).decode("ascii"), uts46=True), "idna"
        except (UnicodeError, ValueError):
            pass
    try:
        return host.encode("idna").decode("ascii").encode("ascii").decode("idna"), "stdlib"
    except (UnicodeError, ValueError):
        return host, None


def _finish(host: str, form: str, percent: bool, idna: bool) -> str:
    host = _percent_decoded(host) if percent else host
    host = unicodedata.normalize(form, host).casefold()
    return _idna(host)[0] if idna else host


STEPS = "decoded string, percent_error boolean, composed string, unicode_error boolean, normalized string, idna_backend string"


def normalization_trace(value: Column, unicode_form: str = "NFKC", decode_percent: bool = True, idna_roundtrip: bool = True) -> Column:
    """The 15 fields of a normalization: input, segmentation, the host after each step, which steps failed, the result.

    Segmentation is native; decoding, composing, case folding and the IDNA round trip are one Arrow function.
    """
    raw = F.coalesce(value.cast("string"), F.lit(""))
    parts = segmented(value)
    before = F.regexp_replace(ustrip(parts["host"]), r"^\.+|\.+$", "")

    @F.pandas_udf(STEPS)
    def steps(hosts: pd.Series) -> pd.DataFrame:
        rows = []
        for h in hosts:
            decoded = _percent_decoded(h) if decode_percent else h
            try:
                composed, failed = unicodedata.normalize(unicode_form, decoded), False
            except ValueError:
                composed, failed = decoded, True
            folded = composed.casefold()
            rows.append((decoded, False, composed, failed, *(_idna(folded) if idna_roundtrip else (folded, None))))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in STEPS.split(", ")])

    s = steps(before)
    return F.struct(
        raw.alias("raw_input"), ustrip(raw).alias("stripped_input"), parts.dropFields("host").alias("segmentation"),
        before.alias("host_before_percent_decode"), s["decoded"].alias("host_after_percent_decode"), (before != s["decoded"]).alias("percent_decode_changed"), s["percent_error"].alias("percent_decode_error"),
        F.lit(unicode_form).alias("unicode_form"), s["composed"].alias("host_after_unicode_normalization"), s["unicode_error"].alias("unicode_normalization_error"), F.lit(True).alias("casefolded"),
        F.lit(idna_roundtrip).alias("idna_roundtrip"), s["idna_backend"].alias("idna_backend"), (F.lit(idna_roundtrip) & s["idna_backend"].isNull()).alias("idna_error"), s["normalized"].alias("normalized_hostname"),
    )


def normalized(value: Column, unicode_form: str = "NFKC", decode_percent: bool = True, idna_roundtrip: bool = True) -> Column:
    """The normalized host; null gives ''.

    Plain ASCII rows are lower-cased natively; only those with other characters, '%', 'xn--', or labels
    that the IDNA codec refuses go through the Arrow function.
    """
    host = segmented(value)["host"]
    host = F.regexp_replace(ustrip(host), r"^\.+|\.+$", "")

    @F.pandas_udf("string")
    def hard(hosts: pd.Series) -> pd.Series:
        return hosts.map(lambda h: None if h is None else _finish(h, unicode_form, decode_percent, idna_roundtrip))

    plain = host.rlike(r"^[A-Za-z0-9_.-]*$") & ~F.lower(host).contains("xn--") & F.forall(labels(host), lambda x: F.char_length(x).between(1, 63))
    return F.when(plain | (host == ""), F.lower(host)).otherwise(hard(F.when(~plain, host)))


def canonical(value: Column) -> Column:
    """Release form: no white space, no final dots, IDNA where it works, lower case."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), f"(?U){WHITE}+", ""), r"\.+$", "")

    @F.pandas_udf("string")
    def hard(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                t = t.encode("idna").decode("ascii")
            except (UnicodeError, ValueError):
                pass
            return t.lower()

        return texts.map(one)

    ascii_only = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, F.lower(text)).otherwise(hard(F.when(~ascii_only, text)))


def length_bucket(value: Column) -> Column:
    n = F.char_length(value)
    return F.when(n <= 15, "1-15").when(n <= 31, "16-31").when(n <= 63, "32-63").when(n <= 127, "64-127").otherwise("128+")


def count_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 7, "4-7").when(n <= 15, "8-15").when(n <= 31, "16-31").when(n <= 63, "32-63").otherwise("64+")


def class_mask(value: Column, most: int = 96) -> Column:
    """A character for each of the first `most`: A upper, a other letter, 9 digit, itself for .-_%, S for shell syntax, x else; + if there are more."""
    def one(c: Column) -> Column:
        return (
            F.when(c.rlike(r"^\p{Lu}$"), "A").when(c.rlike(r"^\p{L}$"), "a").when(c.rlike(r"^\p{Nd}$"), "9").when(c.isin(".", "-", "_", "%"), c)
            .when(c.isin(*"$`;&|<>(){}[]'\""), "S").otherwise("x")
        )

    chars = F.filter(F.split(F.substring(value, 1, most), ""), lambda c: c != "")
    return F.concat(F.array_join(F.transform(chars, one), ""), F.when(F.char_length(value) > most, "+").otherwise(""))


def coarse_mask(mask: Column) -> Column:
    """Counts of the mask's classes, at most 5 each, in code point order."""
    def part(c: str) -> Column:
        n = F.char_length(mask) - F.char_length(F.replace(mask, F.lit(c), F.lit("")))
        return F.when(n > 0, F.concat(F.lit(f"{c}:"), F.least(n, F.lit(5)).cast("string")))

    return F.concat_ws("|", *(part(c) for c in "%-.9AS_a"))


def week_bucket(ts: Column) -> Column:
    """ISO year and week; 'unknown' for what is no timestamp."""
    t = F.expr("try_cast(NULL as timestamp)") if ts is None else F.try_to_timestamp(F.when(ts != "", ts))
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), t), F.extract(F.lit("WEEK"), t))
    return F.when(t.isNull(), "unknown").otherwise(week)


def longer_than(host: Column, least: int = 5) -> Column:
    return F.char_length(host) > least


def without_first_label(host: Column) -> Column:
    """Drops the first label where there are over two."""
    parts = labels(host)
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 2, F.size(parts) - 1), ".")).otherwise(host)


def punctuation_replaced(host: Column) -> Column:
    """Removes the first hyphen; else turns the first underscore, else the first dot, into one."""
    first = lambda c, with_: F.regexp_replace(host, f"^([^{c}]*)[{c}]", f"$1{with_}")
    return F.when(host.contains("-"), first(r"\-", "")).when(host.contains("_"), first("_", "-")).when(host.contains("."), first(r"\.", "-")).otherwise(host)


def url_encoded_layer(text: Column) -> Column:
    """Unreserved ASCII stays; every other character becomes % and its code point in hexadecimal."""
    one = lambda c: F.when(c.rlike(r"^[0-9A-Za-z._~-]$"), c).otherwise(F.concat(F.lit("%"), F.when(F.ascii(c) < 16, "0").otherwise(""), F.hex(F.ascii(c))))
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def base64url_layer(text: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), F.lit("="))


def base32_layer(text: Column) -> Column:
    """Base32 of the UTF-8 bytes without padding: 5 hexadecimal digits are 4 characters."""
    digits = F.hex(F.encode(text, "UTF-8"))
    size = F.ceil(F.char_length(digits) * 4 / 5).cast("int")

    def quad(i: Column) -> Column:
        n = F.conv(F.rpad(F.substring(digits, i * 5 + 1, F.lit(5)), 5, "0"), 16, 10).cast("long")
        return F.concat(*(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (F.shiftright(n, k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in (15, 10, 5, 0)))

    groups = F.sequence(F.lit(0), F.ceil(F.char_length(digits) / 5).cast("int") - 1)
    return F.when(size > 0, F.left(F.array_join(F.transform(groups, quad), ""), size)).when(text.isNotNull(), "")


def nested_escape_layer(text: Column) -> Column:
    """Backslashes doubled, percent signs escaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("%25"))
