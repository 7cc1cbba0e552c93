"""A provider on this machine, for tests of the HTTP boundary without a network."""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable
from functools import lru_cache
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from larkspur.operators.responder import Http, blocks_provider, choices_provider

KEY = "loopback"


def digit_of(prompt: str) -> str:
    """First hexadecimal digit of the prompt's MD5: it decides how the provider answers."""
    return hashlib.md5(prompt.encode()).hexdigest()[0]


def reply_to(prompt: str) -> str:
    return f"Reply to {hashlib.md5(prompt.encode()).hexdigest()}"


class _Handler(BaseHTTPRequestHandler):
    """Digits 0 to 2 get a 503, a body of another shape, and no JSON; others an answer. Calls without the key get a 401."""

    protocol_version = "HTTP/1.1"

    def do_POST(self) -> None:
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        digit, said = digit_of(prompt), f" {reply_to(prompt)}\n"
        blocks = self.path == "/blocks"
        good = {"content": [{"type": "text", "text": said[:9]}, {"type": "tool", "text": "x"}, {"type": "text", "text": said[9:]}]} if blocks else {"choices": [{"message": {"content": said}}]}
        known = KEY in (self.headers.get("x-api-key"), self.headers.get("Authorization", "").removeprefix("Bearer "))
        status = 401 if not known else 503 if digit == "0" else 200
        answer = "busy" if status != 200 or digit == "2" else json.dumps({"choices": []} if digit == "1" else good)
        self.send_response(status)
        self.send_header("Content-Length", str(len(answer)))
        self.end_headers()
        self.wfile.write(answer.encode())

    def log_message(self, *args: object) -> None:
        pass


@lru_cache(maxsize=1)
def address() -> str:
    """Address of this process's own server, which starts with the first call and ends with the process."""
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_port}"


def loopback(blocks: bool = False) -> Callable[[dict], str]:
    """A responder that calls this process's server; prompts of digit 3 go to a closed port, those of digit 4 lack the key."""

    def provider(url: str, key: str | None) -> Http:
        return blocks_provider(f"{url}/blocks", key, "x-api-key", "m") if blocks else choices_provider(f"{url}/choices", key)

    here, closed, keyless = provider(address(), KEY), provider("http://127.0.0.1:9", KEY), provider(address(), None)
    return lambda request: {"3": closed, "4": keyless}.get(digit_of(request["prompt"]), here)(request)
