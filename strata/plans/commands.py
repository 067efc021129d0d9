"""Commands over a store: words in, a reply out. A server, a client and a console share them."""

import socket
import socketserver
import threading

from strata.functions import wire
from strata.functions.wire import OK, Reply

# The commands, the words each takes besides its name, and what it says otherwise.
ARITY = {
    "PING": (0, None, ""),
    "SET": (2, 2, "SET requires 2 arguments: SET key value"),
    "GET": (1, 1, "GET requires 1 argument: GET key"),
    "DEL": (1, None, "DEL requires at least 1 argument: DEL key [key …]"),
    "DBSIZE": (0, None, ""),
    "SCAN": (0, None, ""),
    "COMPACT": (0, None, ""),
    "COMPACT-SST": (0, None, ""),
}


def _delete(store, keys: list[bytes]) -> int:
    """Deletes keys in turn; how many of them were there, a repeated key once."""
    asked = store._keys(keys)
    n = store.exists(asked).count()
    store.delete_many(asked)
    return n


def _pairs(store, start: bytes = b"", end: bytes = b"", *_) -> list[Reply]:
    """An empty bound is none. The result of one command goes through the driver, as the protocol asks."""
    rows = store.scan(start or None, end or None)
    return [Reply("bulk", bytes(v)) for r in rows.toLocalIterator() for v in (r.key, r.value)]


def run(store, args: list[bytes]) -> Reply:
    name, words = args[0].decode(errors="replace").upper(), args[1:]
    if name not in ARITY:
        return Reply("error", f"unknown command '{name}'")
    least, most, usage = ARITY[name]
    if len(words) < least or most is not None and len(words) > most:
        return Reply("error", usage)
    try:
        match name:
            case "PING":
                return Reply("bulk", words[0]) if words else Reply("simple", "PONG")
            case "SET":
                store.set(*words)
            case "GET":
                return Reply("bulk", store.get(words[0]))
            case "DEL":
                return Reply("integer", _delete(store, words))
            case "DBSIZE":
                return Reply("integer", len(store))
            case "SCAN":
                return Reply("array", _pairs(store, *words))
            case "COMPACT":
                store.compact()
            case "COMPACT-SST":
                store.compact_tables()
                return Reply("simple", f"OK sstables={store.table_count()}")
    except (ValueError, OSError) as e:
        return Reply("error", str(e))
    return OK


def console(store, line: str) -> str | None:
    """One line of the console; None ends it. A value may hold spaces."""
    name, *rest = line.split(" ", 2)
    words = [w.encode() for w in rest]
    shown = lambda b: '"' + b.decode(errors="backslashreplace").replace('"', '\\"') + '"'
    name = name.lower()
    if name in ("exit", "quit"):
        return None
    if name == "help":
        return "commands: set <k> <v> | get <k> | del <k> | scan <start> [end] | keys | compact | compact-sst | stats | help | exit"
    if name == "stats":
        s = store.stats()
        return f"keys={s['keys']} segments={s['segments']} sstables={s['tables']} disk={s['log_bytes']}+{s['tables_bytes']} bytes"
    needs = {"set": (2, "set <key> <value>"), "get": (1, "get <key>"), "del": (1, "del <key>"), "delete": (1, "del <key>"), "scan": (1, "scan <start> [end]")}
    if name in needs and len(words) < needs[name][0]:
        return f"usage: {needs[name][1]}"
    if name in ("del", "delete"):
        # The key is the rest of the line's first word; the console does not say whether it was there.
        reply = run(store, [b"DEL", words[0]])
        return "OK" if reply.kind == "integer" else f"ERR {reply.value}"
    known = {"set": b"SET", "get": b"GET", "keys": b"DBSIZE", "scan": b"SCAN", "compact": b"COMPACT", "compact-sst": b"COMPACT-SST"}
    if name not in known:
        return f"unknown command {shown(name.encode())} (try 'help')"
    reply = run(store, [known[name], *(words[:1] if name == "get" else words if name in ("set", "scan") else [])])
    if reply.kind == "error":
        return f"ERR {reply.value}"
    if reply.kind == "array":
        flat = [r.value for r in reply.value]
        return "\n".join([f"{shown(k)} -> {shown(v)}" for k, v in zip(flat[::2], flat[1::2])] + [f"({len(flat) // 2} keys)"])
    if reply.kind == "bulk":
        return "(nil)" if reply.value is None else shown(reply.value)
    return str(reply.value).replace("OK sstables=", "OK (sstables=") + ")" * ("sstables" in str(reply.value))


class Server(socketserver.ThreadingTCPServer):
    """Serves commands; a store takes one command at a time."""

    allow_reuse_address, daemon_threads, block_on_close = True, True, False

    def __init__(self, store, address=("127.0.0.1", 0)):
        lock = threading.Lock()

        class Handler(socketserver.StreamRequestHandler):
            def handle(self):
                reader = wire.Reader(self.rfile)
                while True:
                    try:
                        args = reader.args()
                    except (EOFError, OSError):
                        return
                    except wire.WireError as e:
                        self.wfile.write(wire.encode(Reply("error", str(e))))
                        return
                    if args:
                        with lock:
                            reply = run(store, args)
                        self.wfile.write(wire.encode(reply))

        super().__init__(address, Handler)


class CommandError(RuntimeError):
    pass


class Client:
    """Typed calls over one connection, one at a time."""

    def __init__(self, address):
        self.socket, self.lock = socket.create_connection(address), threading.Lock()
        self.reader = wire.Reader(self.socket.makefile("rb"))

    def call(self, *args: bytes):
        with self.lock:
            self.socket.sendall(wire.command(*args))
            reply = self.reader.reply()
        if reply.kind == "error":
            raise CommandError(str(reply.value))
        return reply.value

    def close(self) -> None:
        self.socket.close()

    def ping(self) -> str:
        return self.call(b"PING")

    def set(self, key: bytes, value: bytes) -> None:
        self.call(b"SET", key, value)

    def get(self, key: bytes) -> bytes | None:
        return self.call(b"GET", key)

    def delete(self, *keys: bytes) -> int:
        return self.call(b"DEL", *keys)

    def dbsize(self) -> int:
        return self.call(b"DBSIZE")

    def scan(self, start: bytes = b"", end: bytes = b"") -> list[tuple[bytes, bytes]]:
        flat = [r.value for r in self.call(b"SCAN", start, end)]
        return list(zip(flat[::2], flat[1::2]))

    def compact(self) -> None:
        self.call(b"COMPACT")

    def compact_tables(self) -> str:
        return self.call(b"COMPACT-SST")
