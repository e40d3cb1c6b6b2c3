"""Progress of a run: one line on a terminal, key=value or JSON elsewhere."""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql.streaming.listener import StreamingQueryListener

STYLES = ("line", "pairs", "json", "off")


def human(n: float) -> str:
    for unit in ("", "k", "M", "G"):
        if abs(n) < 1000:
            return f"{n:.0f}{unit}" if not unit else f"{n:.1f}{unit}"
        n /= 1000
    return f"{n:.1f}T"


class Progress:
    def __init__(self, style: str | None = None, out=None, clock=time.monotonic) -> None:
        self.out = out or sys.stderr
        self.style = style or ("line" if getattr(self.out, "isatty", lambda: False)() else "pairs")
        if self.style not in STYLES:
            raise ValueError(f"no progress style {style!r}")
        self.clock, self.began, self.rows, self.bytes = clock, clock(), 0, 0

    def add(self, table: str, rows: int = 0, size: int = 0, done: bool = False) -> None:
        self.rows += rows
        self.bytes += size
        seconds = max(self.clock() - self.began, 1e-9)
        if self.style == "json":
            text = json.dumps({"table": table, "rows": self.rows, "bytes": self.bytes, "seconds": round(seconds, 3), "done": done}) + "\n"
        elif self.style == "pairs":
            text = f"table={table} rows={self.rows} bytes={self.bytes} seconds={seconds:.3f} done={str(done).lower()}\n"
        elif self.style == "line":
            text = f"\r{table}: {human(self.rows)} rows, {human(self.bytes)}B, {human(self.rows / seconds)} rows/s" + ("\n" if done else "")
        else:
            return
        self.out.write(text)
        self.out.flush()


class QueryProgress(StreamingQueryListener):
    """Feeds a Progress from the windows of streaming queries."""

    def __init__(self, progress: Progress) -> None:
        self.progress = progress

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.progress.add(event.progress.name or str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
