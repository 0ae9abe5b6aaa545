"""Extension points: detectors of one's own and antivirus engines, run partition by partition."""

from __future__ import annotations

import shlex
import socket
import subprocess
import tempfile
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.config import Config
from tamis.operators.detectors import NONE, finding


class Detector(Protocol):
    """Gives a column array<finding> over the columns of a parsed document."""

    def __call__(self, text: Column, metadata: dict[str, Column], config: Config) -> Column: ...


class Engine(Protocol):
    def scan(self, path: str, content: bytes) -> dict:
        """infected (bool), and whatever shall be evidence, as strings; raises TimeoutError or another error."""


class Daemon:
    """A scanning daemon that takes length-prefixed chunks, over a local socket if ``socket_path`` is given, else over TCP, and answers with
    FOUND or OK. Where it cannot be reached, ``fallback`` scans instead."""

    def __init__(self, host: str | None = "localhost", port: int = 3310, timeout: float = 10.0, socket_path: str | None = None, fallback: Engine | None = None):
        self.address, self.timeout, self.socket_path, self.fallback = (host, port), timeout, socket_path, fallback

    def _connected(self) -> socket.socket:
        if self.socket_path:
            s = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
            s.settimeout(self.timeout)
            s.connect(self.socket_path)
            return s
        return socket.create_connection(self.address, self.timeout)

    def scan(self, path: str, content: bytes) -> dict:
        try:
            with self._connected() as s:
                s.sendall(b"zINSTREAM\0")
                for at in range(0, len(content), 4096):
                    chunk = content[at : at + 4096]
                    s.sendall(len(chunk).to_bytes(4, "big") + chunk)
                s.sendall(b"\0\0\0\0")
                said = b""
                while b"\0" not in said and (more := s.recv(4096)):
                    said += more
        except TimeoutError:
            raise
        except OSError:
            if self.fallback is None:
                raise
            return self.fallback.scan(path, content)
        text = said.decode("utf-8", "ignore").strip("\0\r\n ")
        infected = "FOUND" in text and "OK" not in text
        return {"infected": infected, "signature": text.replace("stream:", "").replace("FOUND", "").strip() if infected else "", "raw": text}


class Command:
    """A command line with {path}, run without a shell; infected if its exit code is one of ``codes``."""

    def __init__(self, template: str, codes: tuple[int, ...] = (1,), timeout: float = 10.0):
        self.template, self.codes, self.timeout = template, codes, timeout

    def scan(self, path: str, content: bytes) -> dict:
        with tempfile.NamedTemporaryFile() as f:
            f.write(content)
            f.flush()
            words = [f.name if w == "{path}" else w for w in shlex.split(self.template)]
            try:
                code = subprocess.run(words, capture_output=True, timeout=self.timeout).returncode
            except subprocess.TimeoutExpired as e:
                raise TimeoutError from e
        return {"infected": code in self.codes, "exit_code": str(code)}


def engine(provider: str, **settings) -> Engine:
    """A daemon falls back on the command ``command`` if one is given."""
    command = settings.pop("command", None) if provider == "daemon" else None
    if command:
        settings["fallback"] = Command(command)
    return {"daemon": Daemon, "command": Command}[provider](**settings)


SCANNED = "struct<outcome: string, evidence: map<string,string>>"


def scanned(av: Engine):
    """An Arrow UDF over path and content (null: not to be scanned): outcome (infected, clean, timeout, error) and evidence."""
    kind = pa.struct([("outcome", pa.string()), ("evidence", pa.map_(pa.string(), pa.string()))])

    def one(path: str | None, content: bytes) -> dict:
        try:
            result = av.scan(path or "", content)
            return {"outcome": "infected" if result.get("infected") else "clean", "evidence": [(k, str(v)) for k, v in result.items()]}
        except TimeoutError:
            return {"outcome": "timeout", "evidence": []}
        except Exception as e:
            return {"outcome": "error", "evidence": [("error", type(e).__name__)]}

    @F.arrow_udf(SCANNED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for paths, contents in batches:
            yield pa.array([one(p, c.as_py()) if c.is_valid else None for p, c in zip(paths.to_pylist(), contents)], kind)

    return run


def antivirus_findings(said: Column) -> Column:
    """T1 CRITICAL if infected, T6 MEDIUM on a timeout, T6 LOW on an error."""
    outcome, evidence = said["outcome"], said["evidence"]
    case = F.when(outcome == "infected", F.array(finding("T1_MALWARE", "CRITICAL", "Antivirus detection", "The antivirus engine says that the file is infected.", evidence, "integrations.antivirus")))
    case = case.when(outcome == "timeout", F.array(finding("T6_DOS", "MEDIUM", "AV scan timed out", "The antivirus engine took too long.", module="stage.antivirus")))
    case = case.when(outcome == "error", F.array(finding("T6_DOS", "LOW", "AV check failed", "The antivirus engine failed.", evidence, "stage.antivirus")))
    return case.otherwise(F.array().cast(NONE))


def antivirus(files: DataFrame, av: Engine) -> DataFrame:
    """path and findings of all files, without the other stages."""
    return files.select("path", scanned(av)("path", F.coalesce("content", F.lit(b""))).alias("_s")).select("path", antivirus_findings(F.col("_s")).alias("findings"))
