"""Recognisers that answer for a picture of an invoice with JSON: what one must offer, and one that asks a web service.

Whoever answers, the answer is checked by ``extraction.validated`` before anything of it is used. Without a client the
built-in reader of ``images`` answers.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

#: The keys of an answer and what each holds.
ANSWER_KEYS = {
    "vendor_name": "name of the seller, text or null", "invoice_no": "number of the invoice as printed, text or null", "invoice_date": "date as yyyy-mm-dd, text or null",
    "amount": "amount due, a number or null", "tax_id": "tax number of the seller, text or null", "extraction_confidence": "how sure you are, 0 to 1",
}
KINDS = {"png": "image/png", "jpeg": "image/jpeg", "pdf": "application/pdf"}


class VisionClient(Protocol):
    """Anything that can be sent to the executors and answers for the bytes of one document of a kind of ``KINDS``."""

    def answer(self, content: bytes, kind: str) -> str: ...


def post(url: str, body: bytes, headers: dict[str, str], seconds: float) -> bytes:
    """Send a request and return what comes back."""
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=seconds) as reply:
        return reply.read()


@dataclass(frozen=True)
class ChatClient:
    """Asks a service that takes chat messages with pictures. ``send`` can be replaced, so nothing here needs a network."""

    url: str
    model: str
    key: str = field(default="", repr=False)
    seconds: float = 60.0
    send: Callable[[str, bytes, dict[str, str], float], bytes] = post

    def question(self, content: bytes, kind: str) -> dict:
        wanted = "\n".join(f"- {k}: {v}" for k, v in ANSWER_KEYS.items())
        picture = f"data:{KINDS[kind]};base64,{base64.b64encode(content).decode()}"
        said = [{"type": "text", "text": f"Read this invoice. Answer with one JSON object of these keys, null for what you can't read:\n{wanted}"}, {"type": "image_url", "image_url": {"url": picture}}]
        return {"model": self.model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "user", "content": said}]}

    def answer(self, content: bytes, kind: str) -> str:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            reply = json.loads(self.send(self.url, json.dumps(self.question(content, kind)).encode(), headers, self.seconds))
            return reply["choices"][0]["message"]["content"]
        except (OSError, ValueError, LookupError, TypeError) as failed:
            raise RuntimeError(f"no answer from the recogniser: {failed!r}") from failed
