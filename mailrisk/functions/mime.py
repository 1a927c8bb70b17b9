"""Row-level MIME decoding: bytes in, one nested record out.

This is the only place that looks at raw message bytes. It reports what the
message holds and takes no decision; choosing bodies, attachments and ids is
done on the nested record with column expressions (operators/messages.py).
"""

from __future__ import annotations

import re
import sys
from email import policy
from email.parser import BytesFeedParser
from email.utils import getaddresses, parseaddr

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk.functions.deadline import Deadline, Overdue, records, timed
from mailrisk.schemas import MAIL

# Executors need not have this package installed: the helpers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BODY_TYPES = ("text/plain", "text/html")
# Bytes that the parser is fed between two looks at the clock.
FED_AT_ONCE = 1 << 16

# Headers that were decoded already in this task. Content types, versions, senders and
# recipients repeat from message to message, and the library decodes a header again at
# every look. Long values are not kept, and the table starts over when it is full.
_decoded_headers: dict = {}
CACHED_HEADERS = 4096
CACHED_LENGTH = 512


class _DecodeOnce(policy.EmailPolicy):
    """The library's default policy, remembering decoded headers."""

    def header_fetch_parse(self, name, value):
        found = _decoded_headers.get((name, value))
        if found is None:
            found = super().header_fetch_parse(name, value)
            if len(value) <= CACHED_LENGTH:
                if len(_decoded_headers) >= CACHED_HEADERS:
                    _decoded_headers.clear()
                _decoded_headers[name, value] = found
        return found


_POLICY = _DecodeOnce()

# Values whose decoded text is plain to see; the library builds a tree of each to say the same. Addresses are
# dot-atoms, bare or after a name of plain words; text has no encoded words and nothing beyond printable ASCII.
_ATOMS = r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*"
_WORDS = r"[A-Za-z0-9_-]+(?: [A-Za-z0-9_-]+)*"
_ADDRESS = re.compile(rf' *(?:({_ATOMS})|(?:"({_WORDS})"|({_WORDS})) <({_ATOMS})>) *')
_MESSAGE_ID = re.compile(rf" *(<{_ATOMS}>)")
_TEXT = re.compile(r"[ -~\t\r\n]*")
_LINE_ENDS = re.compile(r"[\r\n]+")
_ADDRESSES = frozenset({"from", "to", "cc", "bcc", "reply-to"})
_TEXTS = frozenset({"subject", "received", "authentication-results"})


def _plain_value(name: str, stored) -> str | None:
    """The text that the library decodes a header to, where it is plain to see; else None."""
    if type(stored) is not str:
        return None
    if name in _TEXTS:
        return _LINE_ENDS.sub("", stored) if _TEXT.fullmatch(stored) and "=?" not in stored else None
    if name == "message-id":
        found = _MESSAGE_ID.fullmatch(stored)
        return found and found[1]
    if name not in _ADDRESSES:
        return None
    found = [_ADDRESS.fullmatch(part) for part in stored.split(",")]
    if not all(found):
        return None
    return ", ".join(m[1] or f"{m[2] or m[3]} <{m[4]}>" for m in found)


def _attempt(call, default=None):
    """Call into the mail library, which may raise on hostile input."""
    try:
        return call()
    except Exception:  # the sender chose these bytes, so nothing about them is certain
        return default


def _clean(text: str | None) -> str | None:
    """Text that Arrow can carry: undecodable bytes left by the parser are replaced."""
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


def _one_line(value) -> str:
    return _clean(" ".join(_attempt(lambda: str(value), "").split()))


def _payload(part) -> bytes | None:
    data = _attempt(lambda: part.get_payload(decode=True))
    return bytes(data) if isinstance(data, (bytes, bytearray)) else None


def _text_of(part) -> str:
    content = _attempt(part.get_content) if hasattr(part, "get_content") else None
    if isinstance(content, str):
        return _clean(content)
    data = _payload(part)
    if data is None:
        return ""
    named = _attempt(part.get_content_charset) or "utf-8"
    return _clean(_attempt(lambda: data.decode(named, "replace")) or data.decode("utf-8", "replace"))


def _parse(raw: bytes, clock: Deadline):
    try:
        return _fed(raw, clock, BytesFeedParser(policy=_POLICY))
    except Overdue:
        raise
    except Exception:  # the older policy reads what this one refuses
        return _fed(raw, clock, BytesFeedParser())


def _fed(raw: bytes, clock: Deadline, parser: BytesFeedParser):
    for at in range(0, len(raw), FED_AT_ONCE):
        clock.check()
        parser.feed(raw[at : at + FED_AT_ONCE])
    return parser.close()


def _headers(message, clock: Deadline) -> dict[str, list[dict]]:
    """Header values by lower-cased name, each with its position in the message."""
    found: dict[str, list[dict]] = {}
    for pos, (name, stored) in enumerate(_attempt(lambda: list(message.raw_items()), [])):
        clock.check()
        known = _clean(str(name)).lower()
        value = _plain_value(known, stored) if message.policy is _POLICY else None
        if value is None:
            value = _attempt(lambda: message.policy.header_fetch_parse(name, stored), "")
        found.setdefault(known, []).append({"pos": pos, "value": _one_line(value)})
    return found


def _part(number: int, part, clock: Deadline) -> dict:
    clock.check()
    disposition = (_attempt(part.get_content_disposition) or "").lower()
    filename = _one_line(_attempt(part.get_filename) or "")
    content_id = _one_line(_attempt(lambda: part.get("Content-ID")) or "")
    content_id = content_id.removeprefix("<").removesuffix(">")
    kind = _clean(_attempt(part.get_content_type))
    is_body = kind in BODY_TYPES and disposition != "attachment" and not filename and not content_id
    return {
        "part_no": number,
        "content_type": kind,
        "disposition": _clean(disposition),
        "filename": filename,
        "content_id": content_id,
        "text": _text_of(part) if is_body else None,
        "size_bytes": len(_payload(part) or b""),
    }


def decode_mail(raw: bytes | None, limit_s: float | None = None) -> dict:
    """One message as a record shaped like schemas.MAIL, without its time; never raises.

    A message that takes longer than limit_s is given up with the reason.
    """
    if raw is None:
        return {"error": "content is missing"}
    clock = Deadline(limit_s)
    try:
        message = _parse(raw, clock)
        headers = _headers(message, clock)
        values = {name: [h["value"] for h in found] for name, found in headers.items()}
        first = {name: found[0] for name, found in values.items()}
        display, address = parseaddr(first.get("from", ""))
        walked = _attempt(lambda: list(message.walk()), [message])
        leaves = [p for p in walked if _attempt(p.get_content_maintype, "multipart") != "multipart"]
        parts = [_part(number, part, clock) for number, part in enumerate(leaves)]
        flat = None
        if all(p["text"] is None for p in parts) and not _attempt(message.is_multipart, True):
            flat = _text_of(message)
        return {
            "headers": list(headers.items()),
            "from_display": display.strip(),
            "from_addr": address.strip(),
            "reply_to": parseaddr(first.get("reply-to", ""))[1].strip() or None,
            "to_addrs": [addr.strip() for _, addr in getaddresses(values.get("to", []))],
            "parts": parts,
            "flat_text": flat,
            "error": None,
        }
    except Overdue as late:
        return {"error": str(late)}
    except Exception as exc:  # reported per message, so one bad row never ends a job
        return {"error": _clean(f"{type(exc).__name__}: {exc}")}


_MAIL_ARROW = pa.struct([
    ("headers", pa.map_(pa.string(), pa.list_(pa.struct([("pos", pa.int32()), ("value", pa.string())])))),
    ("from_display", pa.string()),
    ("from_addr", pa.string()),
    ("reply_to", pa.string()),
    ("to_addrs", pa.list_(pa.string())),
    ("parts", pa.list_(pa.struct([
        ("part_no", pa.int32()), ("content_type", pa.string()), ("disposition", pa.string()),
        ("filename", pa.string()), ("content_id", pa.string()), ("text", pa.string()),
        ("size_bytes", pa.int64()),
    ]))),
    ("flat_text", pa.string()),
    ("error", pa.string()),
    ("elapsed_ms", pa.int64()),
])


def mail_record(content: str, limit_s: float | None = None) -> Column:
    """The decoded record of a message, given up beyond limit_s.

    Declared nondeterministic so that the optimizer never decodes a message twice, once
    for a pushed-down filter and once for the result.
    """
    def _mail_record(values: pa.Array) -> pa.Array:
        return records(values, lambda value: timed(decode_mail, value.as_py(), limit_s), _MAIL_ARROW)

    return F.arrow_udf(_mail_record, MAIL).asNondeterministic()(content)
