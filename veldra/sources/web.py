"""Pages of the web: which addresses are safe, and the text of HTML."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_SKIPPED = frozenset(("script", "style", "nav", "footer", "header"))
#: Addresses of this host or of private or reserved networks, as fixed prefixes: IPv4, then IPv6.
_PRIVATE = r"^(localhost|127\..*|10\..*|0\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\..*|198\.1[89]\..*|22[4-9]\..*|2[345][0-9]\..*)$"
_PRIVATE_6 = r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|::ffff:(127|10|0|169\.254|192\.168)\..*)$"


def url_reason(url: Column) -> Column:
    """``ok``, or why the address isn't fetched: its scheme, no host, or a private one, also as a whole number."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    six = F.regexp_replace(host, r"^\[|\]$", "")
    number = F.when(host.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(host, 3, 8), 16, 10).cast("long")).when(host.rlike("^[0-9]{1,10}$"), host.cast("long"))
    dotted = F.when(number.between(0, 4294967295), F.concat_ws(".", *((F.shiftright(number, s) % 256).cast("string") for s in (24, 16, 8, 0))))
    private = host.rlike(_PRIVATE) | (host.startswith("[") & six.rlike(_PRIVATE_6)) | F.coalesce(dotted.rlike(_PRIVATE), F.lit(False))
    return F.when(url.isNull() | ~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(private, "private").otherwise("ok")


FETCHED = "place int, url string, ok boolean, html string, reason string"


def fetch(urls: DataFrame, get: Callable[[str], str]) -> DataFrame:
    """``place, url, ok, html, reason`` of addresses in their order; unsafe and failing ones have a reason and no page.

    ``get(address)`` gives a page; on a machine without network it is a look-up. ``urls``: place, url.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for place, url, reason in zip(batch["place"], batch["url"], batch["reason"]):
                html = None
                if reason == "ok":
                    try:
                        html = get(url)
                    except Exception as e:  # noqa: BLE001
                        reason = f"{type(e).__name__}: {e}"
                out.append((place, url, html is not None, html, reason))
            yield pd.DataFrame(out, columns=["place", "url", "ok", "html", "reason"])

    return urls.select(F.col("place").cast("int").alias("place"), "url", url_reason(F.col("url")).alias("reason")).mapInPandas(run, FETCHED)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in _SKIPPED

    def handle_endtag(self, tag):
        self.depth -= tag in _SKIPPED and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(" ".join(data.split()))


def _plain(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return " ".join(p.parts)


def html_to_text(html: Column | str) -> Column:
    """Text nodes joined by spaces, without scripts, styles, navigation, headers and footers; null stays."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(_plain)

    return run(html)
