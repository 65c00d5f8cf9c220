"""What keeps a job alive: when it is started again after a failure, and what is known of it meanwhile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQueryListener

# Parts of an error's text, or of the classes among its causes, that tell a failure to read the source.
_SOURCE_SIGNS = ("[FAILED_READ_FILE", "[PYTHON_STREAMING_DATA_SOURCE", "org.apache.kafka.", "spark.sql.kafka010")


@dataclass(frozen=True)
class RestartPolicy:
    """How a job goes on whose source failed: after waits that double up to a bound, as often as is said.

    Attempts count in a row: a batch that gets through starts the count anew. Without `max_attempts` there is no end.
    """

    first_delay_sec: float = 5.0
    max_delay_sec: float = 60.0
    max_attempts: int | None = None

    def delay(self, attempt: int) -> float | None:
        """The wait before the given attempt (from 1), None if there is to be none."""
        if self.max_attempts is not None and attempt > self.max_attempts:
            return None
        return min(self.first_delay_sec * 2.0 ** min(attempt - 1, 60), self.max_delay_sec)


def is_source_failure(error_class: str | None, text: str, in_batch: bool) -> bool:
    """Whether an error is the source's, so that another attempt may succeed.

    Outside a batch only the source and its offsets can fail. The steps of a batch read the source while they
    write Bronze; there the error has to say so. All other errors of a batch would come again.
    """
    known = f"[{error_class or ''}] {text}"
    return not in_batch or any(sign in known for sign in _SOURCE_SIGNS)


class JobWatch(StreamingQueryListener):
    """Facts about one query, as its events tell them."""

    def __init__(self) -> None:
        self.run_id: str | None = None
        self.batches, self.idle_since = 0, None
        self.error_class: str | None = None
        self.error: str | None = None
        self.ended = False

    def follow(self, run_id: str) -> None:
        """From now on this run is followed."""
        self.__init__()
        self.run_id = run_id

    def _mine(self, run_id) -> bool:
        return self.run_id is not None and str(run_id) == self.run_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self._mine(event.progress.runId):
            self.batches += 1
            self.idle_since = None

    def onQueryIdle(self, event) -> None:
        if self._mine(event.runId):
            self.idle_since = event.timestamp

    def onQueryTerminated(self, event) -> None:
        if self._mine(event.runId):
            self.error, self.error_class = event.exception, event.errorClassOnException
            self.ended = True
