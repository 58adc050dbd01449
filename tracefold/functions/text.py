"""Text expressions: cleaning, tokens, URL parts, decoding, attack patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as missing, device families in order, protocol numbers, label rules in order.
NULL_TEXTS = ("", "-", "--", "n/a", "na", "nan", "none", "null")
DEVICE_FAMILIES = (
    ("mobile", ("android", "iphone", "ios", "mobile", "phone")),
    ("tablet", ("ipad", "tablet")),
    ("desktop", ("windows", "mac", "linux", "desktop", "laptop", "pc")),
    ("server", ("server", "vm", "container", "bot", "crawler")),
)
PROTOCOLS = {6: "tcp", 17: "udp", 1: "icmp"}
FAMILY_RULES = (
    ("benign", "Benign"),
    ("bot", "Bot"),
    ("brute force", "Brute Force"),
    ("ftp_bruteforce", "Brute Force"),
    ("ssh_bruteforce", "Brute Force"),
    ("ddos", "DDoS"),
    ("dos", "DoS"),
    ("web attack", "Web Attack"),
    ("sql injection", "Web Attack"),
    ("xss", "Web Attack"),
    ("infilteration", "Infiltration"),
    ("infiltration", "Infiltration"),
    ("heartbleed", "Heartbleed"),
)
# Attack patterns.
SQL = (
    r"(?i)(?:\bunion\b(?:\s+all)?\s+\bselect\b|\bselect\b\s+.+\bfrom\b|\b(?:drop|insert|update|delete)\b\s+\b(?:table|into|from|set)\b|"
    r"\bor\s+['\"]?\w+['\"]?\s*=\s*['\"]?\w+['\"]?|\bor\s+1\s*=\s*1\b|(?<!\*)/\*|--)"
)
TRAVERSAL = r"(?i)(?:\.\./|\.\.\\|%2e%2e|%252e%252e|/etc/passwd|windows\\win\.ini)"
XSS = r"(?i)(?:<script|<svg|java\s*script\s*:|javascript:|onerror\s*=|onload\s*=|alert\s*\(|confirm\s*\()"
LOG4J = r"(?i)(?:\$\{\s*jndi\s*:|jndi\s*:\s*(?:ldap|rmi|dns)\s*:)"
RCE = r"(?i)(?:__globals__|__builtins__|__mro__|__subclasses__|\$\{ifs\}|exec\s*\(|system\s*\(|cmd=|powershell|/bin/sh|/etc/passwd|[`;&|]\s*(?:id|cat|uname|whoami)\b)"
LOG_FORGING = r"(?i)(?:%0a|%0d|\\n|\\r|\n|\r|\u2028|\u2029)"
PATTERNS = {"sql_keywords": SQL, "traversal": TRAVERSAL, "xss": XSS, "log4j": LOG4J, "rce": RCE, "log_forging": LOG_FORGING}
# What a match of a pattern must contain, in lower case: one of these. The other patterns have a part that nearly any text contains.
REQUIRED = {
    TRAVERSAL: ("../", "..\\", "%2e%2e", "%252e%252e", "/etc/passwd", "windows\\win.ini"),
    XSS: ("script", "<svg", "onerror", "onload", "alert", "confirm"),
    LOG4J: ("jndi",),
    SQL: ("union", "select", "drop", "insert", "update", "delete", "or", "/*", "--"),
}
_FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")  # the letters beyond ASCII that a pattern without regard to case takes for one of ASCII
SPECIAL_CHARACTERS = r"['\";<>{}\[\]\(\)$]"


def java(pattern: str) -> str:
    """Flags under which Java reads a pattern as it is meant: only \\n ends a line, classes are Unicode."""
    return "(?dU)" + pattern


def _possible(text: Column, pattern: str) -> Column | None:
    """Whether the text has a literal that the pattern needs; None if it needs none. Far cheaper than the pattern, which only the rest has to meet."""
    low = F.lower(F.translate(text, *_FOLDED))
    found = [low.contains(x) for x in REQUIRED.get(pattern, ())]
    return reduce(lambda x, y: x | y, found) if found else None


def contains(text: Column, pattern: str) -> Column:
    possible, met = _possible(text, pattern), text.rlike(java(pattern))
    return F.coalesce(met if possible is None else possible & met, F.lit(False)).cast("int")


def occurrences(text: Column, pattern: str) -> Column:
    possible, n = _possible(text, pattern), F.regexp_count(text, F.lit(java(pattern)))
    return F.coalesce(n if possible is None else F.when(possible, n), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Trimmed, lower-cased text with white space collapsed; "unknown" for null and for the texts that mean it."""
    low = F.lower(strip(F.coalesce(c.cast("string"), F.lit("unknown"))))
    return F.regexp_replace(F.when(low.isin(*NULL_TEXTS), F.lit("unknown")).otherwise(low), r"(?U)\s+", " ")


def outcome(c: Column) -> Column:
    """true/yes/1 and false/no/0 to 1 and 0, other numbers cut to whole ones, anything else 0."""
    low = F.lower(strip(c.cast("string")))
    value = low.try_cast("double")
    whole = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value).cast("long")
    return F.when(low.isin("true", "yes"), F.lit(1)).when(low.isin("false", "no"), F.lit(0)).otherwise(F.coalesce(whole, F.lit(0))).cast("long")


def device_family(c: Column) -> Column:
    out = F.when(c.isin("", "unknown", "nan", "none", "null") | c.isNull(), F.lit("unknown_device"))
    for family, words in DEVICE_FAMILIES:
        out = out.when(c.rlike("|".join(words)), F.lit(family))
    return out.otherwise(F.lit("other_device"))


def geo_token(country: Column, region: Column, city: Column) -> Column:
    known = lambda c: c != "unknown"
    return (
        F.when(known(country) & known(region) & known(city), "geo_country_region_city")
        .when(known(country) & known(region), "geo_country_region")
        .when(known(country), "geo_country_only")
        .otherwise("geo_unknown")
    )


def ip_token(c: Column) -> Column:
    """The class of an address. Private (with loopback and reserved IPv4 space) comes first, as registries define it."""
    octet = [F.regexp_extract(c, rf"^{r'\d{1,3}\.' * i}(\d{{1,3}})", 1).try_cast("int") for i in range(4)]
    a, b, d, e = octet
    v4 = c.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    private = (
        a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & (d == 0) & ~e.isin(9, 10)) | ((a == 192) & (b == 0) & (d == 2)) | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (d == 100)) | ((a == 203) & (b == 0) & (d == 113)) | (a >= 240)
    )
    low = F.lower(c)
    v6 = low.rlike(r"^[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:.]*$")
    private6 = low.rlike(r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|2001:db8:.*|100::.*|3fff:.*|5f00:.*)$")
    return (
        F.when(c.isin("", "unknown", "nan", "none", "null") | c.isNull(), F.lit("unknown_ip"))
        .when(v4 & private, F.lit("ipv4_private"))
        .when(v4 & a.between(224, 239), F.lit("ipv4_multicast"))
        .when(v4, F.lit("ipv4_public"))
        .when(v6 & private6, F.lit("ipv6_private"))
        .when(v6 & low.startswith("ff"), F.lit("ipv6_multicast"))
        .when(v6 & ~low.rlike(r"^(?:2|3)[0-9a-f]{3}:"), F.lit("ipv6_reserved"))
        .when(v6, F.lit("ipv6_public"))
        .otherwise(F.lit("invalid_ip"))
    )


def protocol_token(c: Column) -> Column:
    out = F.when(c.isNull(), F.lit("other_protocol"))
    for value, name in PROTOCOLS.items():
        out = out.when(c == value, F.lit(name))
    return out.otherwise(F.lit("other_protocol"))


def port_token(c: Column) -> Column:
    return F.when(c < 0, "invalid_port").when(c <= 1023, "system_port").when(c <= 49151, "registered_port").otherwise("dynamic_port")


def attack_family(label: Column) -> Column:
    low = F.lower(strip(label.cast("string")))
    out = F.when(low.isNull(), F.lit("Unknown"))
    for word, family in FAMILY_RULES:
        out = out.when(low.contains(word), F.lit(family))
    return out.otherwise(F.lit("Unknown"))


def scenario_tool(scenario: Column) -> Column:
    low = F.lower(strip(F.coalesce(scenario, F.lit("unknown"))))
    out = F.when(low.startswith("backbone_capture_"), F.lit("benign"))
    for tool in ("hydra", "patator", "ncrack"):
        out = out.when(low.endswith(f"_{tool}"), F.lit(tool))
    return out.otherwise(F.lit("unknown"))


def scenario_app(scenario: Column) -> Column:
    low = F.lower(strip(F.coalesce(scenario, F.lit("unknown"))))
    app = F.regexp_replace(low, "_(?:hydra|patator|ncrack)$", "")
    return F.when(low.startswith("backbone_capture_"), F.lit("backbone_capture")).when(app == "", F.lit("unknown")).otherwise(app)


def service_key(sni: Column, ip: Column, port: Column, protocol: Column) -> Column:
    name = F.coalesce(F.nullif(sni, F.lit("")), F.nullif(ip, F.lit("")), F.lit("unknown"))
    return F.concat_ws(":", name, port.cast("long").cast("string"), protocol.cast("long").cast("string"))


def unquote(c: Column, plus: bool = True) -> Column:
    """Percent decoding; a stray % stays, and + is a space if `plus`."""
    safe = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(safe if plus else F.replace(safe, F.lit("+"), F.lit("%2B")))


def deobfuscate(c: Column) -> Column:
    """Lookups such as ${::-j} and ${lower:j} put back to their letter."""
    c = F.regexp_replace(c, r"\$\{\s*::-\s*([a-zA-Z])\s*\}", "$1")
    return F.regexp_replace(c, r"(?i)\$\{\s*(?:lower|upper)\s*:\s*([a-zA-Z])\s*\}", "$1")


def decoded(c: Column, rounds: int = 3) -> Column:
    for _ in range(rounds):
        c = unquote(c)
    return c


def canonical_text(c: Column) -> Column:
    """Decoded up to three times, lookups and comments undone."""
    return F.regexp_replace(deobfuscate(decoded(F.coalesce(c, F.lit("")))), r"(?d)/\*.*?\*/", " ")


def canonical(c: Column) -> Column:
    """Canonical text, and once more without white space."""
    out = canonical_text(c)
    return F.concat(out, F.lit(" "), F.regexp_replace(out, r"(?U)\s+", ""))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def host_is_ip(host: Column) -> Column:
    return contains(host, r"^\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?$")


def path_template(path: Column) -> Column:
    """Segments of digits, hex and long mixed tokens as {num}, {hex}, {token}; the others lower-cased; empty ones dropped."""
    def shape(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), F.lit("{num}"))
            .when(s.rlike(r"(?i)^(?:[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{13,})$"), F.lit("{hex}"))
            .when((F.length(s) >= 24) & s.rlike("[0-9]") & s.rlike("[A-Za-z]"), F.lit("{token}"))
            .otherwise(F.lower(s))
        )

    kept = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(kept, shape), "/"))


def query_pairs(query: Column) -> Column:
    """Sorted (key, value) pairs, decoded, keys lower-cased and trimmed; blank values stay."""
    parts = F.filter(F.split(query, "&"), lambda s: s != "")
    twice = lambda x: unquote(unquote(x), plus=False)
    pair = lambda s: F.struct(
        F.lower(strip(twice(F.regexp_extract(s, "^([^=]*)", 1)))).alias("k"), strip(twice(F.regexp_extract(s, "^[^=]*=?([\\s\\S]*)$", 1))).alias("v")
    )
    return F.array_sort(F.transform(parts, pair))


def path_depth(path: Column) -> Column:
    return F.greatest(F.lit(0), F.regexp_count(path, F.lit("/")) - path.startswith("/").cast("int"))


# Shapes of parameter values in order, tested on the lower-cased value.
SHAPES = (
    ("newline", LOG_FORGING.replace("|\\u2028|\\u2029", "")),
    ("script", r"<script|javascript:|onerror=|onload=|alert\("),
    ("traversal", r"\.\./|\.\.\\|%2e%2e|%252e%252e"),
    ("lookup", r"\$\{jndi:|ldap:|rmi:|dns:"),
    ("command", r"__globals__|__builtins__|exec\(|system\(|cmd=|powershell|/bin/sh"),
    ("sql", SQL),
)


def value_shape(c: Column) -> Column:
    """What a parameter's value looks like; the first rule that holds."""
    value = F.coalesce(c, F.lit(""))
    out = F.when(value == "", F.lit("empty"))
    for name, pattern in SHAPES:
        out = out.when(F.lower(value).rlike(java(pattern)), F.lit(name))
    return (
        out.when(F.length(value) >= 32, F.lit("long")).when(value.rlike("^[0-9]+$"), F.lit("number")).when(value.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("hex")).otherwise(F.lit("plain"))
    )


def tokens(c: Column) -> Column:
    """White-space tokens; none for an empty text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def lexical_tokens(c: Column, most: int | None = 32, length: int = 48) -> Column:
    """Names, numbers and runs of signs, each cut to a length: the first `most`, or all if None.

    The default is of a single value of a request; a document needs None.
    """
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[a-zA-Z_][a-zA-Z0-9_]{1,40}|[0-9]+|[./\\$\{}:;|&`<>()='\"-]+"), F.lit(0))
    cut = F.transform(found, lambda x: F.left(x, F.lit(length)))
    return cut if most is None else F.slice(cut, 1, most)
