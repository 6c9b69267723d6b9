"""Remote resources, local references and links of HTML, and a sanitised preview; nothing is ever fetched."""

from __future__ import annotations

import html
import ipaddress
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.types import ddl

EVIDENCE = ddl(
    "remote_resources array<struct<kind: string, source: string, url: string, scheme: string, host: string, declared_width: long, declared_height: long, hidden: boolean, "
    "signals: array<string>>>, local_references array<string>, links array<string>"
)
# What a preview keeps (fixed values): elements, attributes of any element and of some, attributes that hold URLs, schemes.
KEPT_TAGS = frozenset(
    "a abbr acronym area article aside b bdi bdo blockquote br caption center cite code col colgroup data dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr i img "
    "ins kbd li map mark nav ol p pre q rp rt rtc ruby s samp small span strike strong sub summary sup table tbody td th thead time tr tt u ul var wbr".split()
)
KEPT_ATTRIBUTES = frozenset(("lang", "title"))
ATTRIBUTES_OF = {
    "a": "href hreflang", "bdo": "dir", "blockquote": "cite", "col": "align char charoff span", "colgroup": "align char charoff span", "del": "cite datetime", "hr": "align size width", "img": "align alt height src width",
    "ins": "cite datetime", "ol": "start", "q": "cite", "table": "align char charoff summary", "tbody": "align char charoff", "td": "align char charoff colspan headers rowspan", "tfoot": "align char charoff",
    "th": "align char charoff colspan headers rowspan scope", "thead": "align char charoff", "tr": "align char charoff",
}
URL_ATTRIBUTES = frozenset(("href", "src", "cite"))
SCHEMES = frozenset("bitcoin ftp ftps geo http https im irc ircs magnet mailto mms mx news nntp openpgp4fpr sip sms smsto ssh tel url webcal wtai xmpp".split())
#: Elements whose contents go, too, and elements without an end (fixed values).
EMPTIED, VOID = frozenset(("script", "style")), frozenset("area br col hr img wbr".split())
#: The policy of a preview's page (fixed value).
POLICY = "default-src 'none'; img-src 'self'; style-src 'unsafe-inline'; script-src 'none'; connect-src 'none'; object-src 'none'; frame-src 'none'; form-action 'none'; base-uri 'none'"

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_CONTROLS = "".join(map(chr, range(33)))
_FORBIDDEN = re.compile(r"[\x00-\x20\x7f#%/:<>?@\[\\\]^|]")


def _number(text: str) -> int | None:
    """A decimal, octal or hexadecimal part of an IPv4 address."""
    base, digits = (16, text[2:]) if text[:2].lower() == "0x" else (8, text[1:]) if len(text) > 1 and text[0] == "0" else (10, text)
    try:
        return int(digits or "0", base) if digits.isascii() and "_" not in digits and "+" not in digits and "-" not in digits else None
    except ValueError:
        return None


def _host(text: str) -> str | None:
    """A host of http URLs as browsers read it: percent-decoded, in ASCII and lower case, numbers as IPv4; None: not a host."""
    if text.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1])}]" if text.endswith("]") else None
        except ValueError:
            return None
    name = unquote(text, errors="strict") if "%" in text else text
    try:
        name = name.lower() if name.isascii() else name.encode("idna").decode().lower()
    except UnicodeError:
        return None
    if not name or _FORBIDDEN.search(name):
        return None
    labels = name.removesuffix(".").split(".")
    if not (labels[-1].isdigit() or _number(labels[-1]) is not None and labels[-1]):
        return name
    numbers = [_number(x) if x else None for x in labels]
    if len(numbers) > 4 or None in numbers or any(x > 255 for x in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    return str(ipaddress.IPv4Address(sum(x << 8 * (3 - i) for i, x in enumerate(numbers[:-1])) + numbers[-1]))


def remote(url: str) -> tuple[str, str, bool] | None:
    """Scheme, host and whether there is a query, for http, https and protocol-relative URLs, read as browsers do.

    Spaces and controls around the URL, tabs and line feeds in it don't count; any number of slashes or backslashes, also
    none, may follow the scheme.
    """
    relative = url.startswith("//")
    text = (f"https:{url}" if relative else url).strip(_CONTROLS)
    text = re.sub(r"[\t\n\r]", "", text)
    found = _SCHEME.match(text)
    if not found or found[1].lower() not in ("http", "https"):
        return None
    rest = text[found.end() :].lstrip("/\\")
    authority = re.match(r"[^/\\?#]*", rest)[0].rpartition("@")[2]
    name, port = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", authority, re.S).groups() if re.fullmatch(r"(?:\[[^\]]*\]|[^:]*)(?::.*)?", authority, re.S) else ("", None)
    try:
        host = _host(name)
    except UnicodeDecodeError:
        host = None
    if host is None or port and not (port.isascii() and port.isdigit() and int(port) < 65_536):
        return None
    return "protocol-relative" if relative else found[1].lower(), host, "?" in text.split("#", 1)[0]


def css_urls(css: str) -> Iterator[str]:
    """What stands between ``url(`` and the next closing parenthesis, without spaces and quotes around it."""
    for found in re.finditer(r"(?=url\(([^)]*)\))", css):
        yield found[1].strip().strip("'\"")


class Style(dict):
    """A style attribute's properties by lower-case name; the first of a name holds."""

    def __init__(self, text: str):
        super().__init__()
        for declaration in text.lower().split(";"):
            if ":" in declaration:
                name, value = map(str.strip, declaration.split(":", 1))
                self.setdefault(name, value)


#: Properties and values that hide an element (fixed values).
HIDING = {"display": "none", "visibility": "hidden", "opacity": "0"}


def _pixels(texts: list[str | None]) -> int | None:
    """The first of the texts that is a number of pixels."""
    for text in texts:
        digits = re.sub("(?:px)+$", "", (text or "").strip()).removeprefix("+")
        if digits.isascii() and digits.isdigit() and int(digits) < 1 << 32:
            return int(digits)
    return None


def shape(held: dict[str, str]) -> dict:
    """Declared width and height (attribute, then style), and whether the style hides the element."""
    style = Style(held.get("style", ""))
    sizes = {f"declared_{side}": _pixels([held.get(side), style.get(side)]) for side in ("width", "height")}
    return sizes | {"hidden": any(style.get(name) == value for name, value in HIDING.items())}


def _candidates(srcset: str) -> list[str]:
    return [words[0] for words in map(str.split, srcset.split(",")) if words]


#: Where resources are named: element (None: any), attribute, kind, source, and the URLs in the attribute's value.
PLACES: list[tuple[str | None, str, str, str, Callable[[str], list[str] | Iterator[str]]]] = [
    ("img", "src", "image", "img-src", lambda value: [value]),
    ("img", "srcset", "image", "img-srcset", _candidates),
    (None, "style", "css-background", "style-attribute", css_urls),
]
SHAPELESS = {"declared_width": None, "declared_height": None, "hidden": False}


class _Collector(HTMLParser):
    """Evidence in the order of the elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list] = {name: [] for name in EVIDENCE.names}
        self.style: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        held: dict[str, str] = {}
        for name, value in attrs:
            held.setdefault(name, value or "")
        declared = None
        for element, attribute, kind, source, urls in PLACES:
            if attribute in held and element in (None, tag):
                declared = declared or shape(held)
                for url in urls(held[attribute]):
                    self.note({"kind": kind, "source": source, "url": url}, declared)
        if tag == "a" and remote(held.get("href", "")):
            self.found["links"].append(held["href"])
        self.end_style()
        self.style = [] if tag == "style" else None

    def handle_endtag(self, tag: str) -> None:
        if tag == "style":
            self.end_style()

    def handle_data(self, data: str) -> None:
        if self.style is not None:
            self.style.append(data)

    def end_style(self) -> None:
        text, self.style = "".join(self.style or ()), None
        for url in css_urls(text):
            self.note({"kind": "css-background", "source": "style-block", "url": url}, SHAPELESS)

    def close(self) -> None:
        super().close()
        self.end_style()

    def note(self, resource: dict, declared: dict) -> None:
        known, url = remote(resource["url"]), resource["url"]
        if known is None:
            if ":" not in url or url.startswith(("cid:", "data:", "#")):
                self.found["local_references"].append(url)
            return
        scheme, host, query = known
        signals = {"tiny-dimensions": 1 in (declared["declared_width"], declared["declared_height"]), "hidden": declared["hidden"], "query-parameters": query}
        self.found["remote_resources"].append(resource | declared | {"scheme": scheme, "host": host, "signals": [name for name, on in signals.items() if on]})


def evidence(text: str | None) -> dict:
    """All fields of EVIDENCE for one document; null and empty documents have none."""
    collector = _Collector()
    collector.feed(text or "")
    collector.close()
    return collector.found


def normal_cid(value: str) -> str | None:
    """A Content-ID reference without brackets around it and without percent signs; None if it is blank or no text."""
    text = value.strip()
    for opening, closing in (("&lt;", "&gt;"), ("<", ">")):
        if text.startswith(opening) and text.endswith(closing) and len(text) >= len(opening) + len(closing):
            text = text[len(opening) : -len(closing)]
            break
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return None
    try:
        text = unquote_to_bytes(text).decode().strip()
    except UnicodeDecodeError:
        return None
    return (text[1:-1] if len(text) > 1 and text[0] == "<" and text[-1] == ">" else text) or None


def rewrite_cids(text: str, routes: dict[str, str]) -> str:
    """``cid:`` references of known ids become their routes; others stay. A reference ends at white space or a quote."""
    known = lambda m: routes.get(normal_cid(m[1]) or "", m[0])
    return re.sub(r"(?i:cid:)([^ \t\n\f\r\"']*)", known, text)


def _may_load(url: str) -> bool:
    """Whether a URL is relative or of a kept scheme."""
    found = _SCHEME.match(re.sub(r"[\t\n\r]", "", url.strip(_CONTROLS)))
    return not found or found[1].lower() in SCHEMES


def _escaped(text: str, quoted: bool = False) -> str:
    out = text.replace("&", "&amp;").replace("\u00a0", "&nbsp;")
    return out.replace('"', "&quot;") if quoted else out.replace("<", "&lt;").replace(">", "&gt;")


class _Cleaner(HTMLParser):
    """Kept elements with kept attributes, all closed; of other elements the contents stay, but for scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.count: dict[str, int] = defaultdict(int)
        self.emptied = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in EMPTIED:
            self.emptied = 1
        elif not self.emptied and tag in KEPT_TAGS:
            names = KEPT_ATTRIBUTES | set(ATTRIBUTES_OF.get(tag, "").split())
            held: dict[str, str] = {}
            for name, value in attrs:
                if name in names and (name not in URL_ATTRIBUTES or _may_load(value or "")):
                    held.setdefault(name, value or "")
            if tag == "a":
                held["rel"] = "noopener noreferrer"
            self.out.append(f"<{tag}" + "".join(f' {n}="{_escaped(v, True)}"' for n, v in held.items()) + ">")
            if tag not in VOID:
                self.open.append(tag)
                self.count[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in EMPTIED:
            self.emptied = 0
        elif not self.emptied and self.count[tag]:
            while self.close_last() != tag:
                pass

    def close_last(self) -> str:
        tag = self.open.pop()
        self.count[tag] -= 1
        self.out.append(f"</{tag}>")
        return tag

    def handle_data(self, data: str) -> None:
        if not self.emptied:
            self.out.append(_escaped(data))

    def close(self) -> None:
        super().close()
        while self.open:
            self.close_last()


def sanitise(text: str, routes: dict[str, str] | None = None) -> str:
    """A preview: known ``cid:`` images by their routes, kept elements only, and a policy by which nothing else loads."""
    cleaner = _Cleaner()
    cleaner.feed(rewrite_cids(text, routes or {}))
    cleaner.close()
    return f'<!doctype html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{POLICY}"></head><body>{"".join(cleaner.out)}</body></html>'


@F.pandas_udf(EVIDENCE)
def analyse_html(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([evidence(t) for t in text], columns=EVIDENCE.names)


@F.pandas_udf(StringType())
def sanitised(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else sanitise(t))


def with_evidence(df: DataFrame, column: str = "html") -> DataFrame:
    """``df`` with a struct ``evidence`` (EVIDENCE)."""
    return df.withColumn("evidence", analyse_html.asNondeterministic()(column))  # once, also where rows are filtered by it


def remote_resources(df: DataFrame, key: str) -> DataFrame:
    """One row a remote resource, with its position."""
    return df.select(key, F.posexplode("evidence.remote_resources").alias("position", "r")).select(key, "position", "r.*")


def links(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("evidence.links").alias("position", "url"))
