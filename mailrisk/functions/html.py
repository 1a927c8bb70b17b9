"""Row-level HTML scan: visible text and URL-bearing elements, in one pass.

A tolerant reader over the standard library tokenizer. Nothing is rendered or
fetched. An element stays open until an end tag of its name arrives, which also
closes whatever was left open inside it; an end tag without a start is ignored.
"""

from __future__ import annotations

import html
import sys
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk.functions.deadline import Deadline, Overdue, records, timed
from mailrisk.schemas import HTML_SCAN

# Executors need not have this package installed: the helpers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Where a URL sits, by element.
URL_ATTRIBUTES = {
    "a": ("href", "anchor_href"),
    "img": ("src", "img_src"),
    "form": ("action", "form_action"),
}
# Elements whose text is not page text, and elements without an end tag.
HIDDEN = frozenset({"script", "style", "template", "rt", "rp"})
VOID = frozenset({
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid",
    "param", "source", "spacer", "track", "wbr",
})


# Pieces of markup between two looks at the clock.
STEPS = 256


class _Scanner(HTMLParser):
    def __init__(self, clock: Deadline) -> None:
        super().__init__(convert_charrefs=False)
        self._clock = clock
        self._steps = 0
        self.texts: list[str] = []
        self.links: list[dict] = []
        self._open: list[tuple[str, dict | None]] = []
        self._names: Counter[str] = Counter()
        self._pending: list[str] = []

    def _tick(self) -> None:
        self._steps += 1
        if self._steps % STEPS == 0:
            self._clock.check()

    def _end_text(self) -> None:
        """Close the text node being read; only visible, non-blank nodes are kept."""
        node = "".join(self._pending).strip()
        self._pending.clear()
        if node and not any(self._names[name] for name in HIDDEN):
            self.texts.append(node)

    def handle_starttag(self, tag, attrs) -> None:
        self._tick()
        self._end_text()
        link = None
        if tag in URL_ATTRIBUTES:
            attribute, source = URL_ATTRIBUTES[tag]
            values = dict(attrs)
            if attribute in values:
                link = {"source": source, "href": values[attribute] or "", "start": len(self.texts)}
                self.links.append(link)
        if tag not in VOID:
            self._open.append((tag, link))
            self._names[tag] += 1

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        self._tick()
        self._end_text()
        while self._names[tag]:
            name, link = self._open.pop()
            self._names[name] -= 1
            if link is not None:
                link["stop"] = len(self.texts)
            if name == tag:
                break

    def handle_data(self, data) -> None:
        self._tick()
        self._pending.append(data)

    def handle_charref(self, name) -> None:
        self._tick()
        self._pending.append(html.unescape(f"&#{name};"))

    def handle_entityref(self, name) -> None:
        self._tick()
        known = html5.get(f"{name};")
        self._pending.append(known if known is not None else f"&{name}")

    def handle_comment(self, data) -> None:
        self._tick()
        self._end_text()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data) -> None:
        self._end_text()
        if data.upper().startswith("CDATA["):
            self._pending.append(data[len("CDATA["):])
            self._end_text()

    def close(self) -> None:
        super().close()
        self._end_text()

    def stop(self) -> None:
        """End the reading where the tokenizer gave up."""
        self._end_text()


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def scan_html(markup: str | None, limit_s: float | None = None) -> dict | None:
    """Visible text (one node per line) and links; NULL in gives NULL out.

    Markup that the tokenizer refuses is read up to there, with the reason in `error`:
    what was read is evidence, but what was not cannot be called clean. So is markup that takes longer
    than limit_s.
    """
    if markup is None:
        return None
    clock = Deadline(limit_s)
    scanner, error = _Scanner(clock), None
    try:
        scanner.feed(markup)
        scanner.close()
    except Overdue as late:
        error = str(late)
        scanner.stop()
    except Exception as exc:  # hostile markup the tokenizer refuses
        error = _clean(f"{type(exc).__name__}: {exc}")
        scanner.stop()
    links = []
    for pos, link in enumerate(scanner.links):
        text = None
        if link["source"] == "anchor_href":
            text = "".join(scanner.texts[link["start"]:link.get("stop", len(scanner.texts))]) or None
        links.append({
            "pos": pos,
            "source": link["source"],
            "href": _clean(link["href"]),
            "anchor_text": text and _clean(text),
        })
    return {"text": _clean("\n".join(scanner.texts)), "links": links, "error": error}


_SCAN_ARROW = pa.struct([
    ("text", pa.string()),
    ("links", pa.list_(pa.struct([
        ("pos", pa.int32()), ("source", pa.string()), ("href", pa.string()),
        ("anchor_text", pa.string()),
    ]))),
    ("error", pa.string()),
    ("elapsed_ms", pa.int64()),
])


def html_scan(markup: str, limit_s: float | None = None) -> Column:
    """Text and links of markup, read up to limit_s. Nondeterministic, so that the optimizer never reads it twice."""
    def _html_scan(values: pa.Array) -> pa.Array:
        return records(values, lambda value: timed(scan_html, value.as_py(), limit_s), _SCAN_ARROW)

    return F.arrow_udf(_html_scan, HTML_SCAN).asNondeterministic()(markup)
