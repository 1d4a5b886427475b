"""Format errors that name the check that failed."""

from __future__ import annotations

from contextlib import contextmanager


class DGGSFormatError(ValueError):
    """check: what was tested; declared against observed; the store and the conventions involved, where known."""

    def __init__(self, check: str, declared=None, observed=None, store: str | None = None, conventions=(), detail: str = ""):
        self.check, self.declared, self.observed, self.store, self.conventions, self.detail = check, declared, observed, store, tuple(conventions), detail
        parts = [f"{check}: declared {declared!r}, observed {observed!r}"]
        if self.conventions:
            parts.append(f"conventions {', '.join(self.conventions)}")
        if store:
            parts.append(f"store {store}")
        super().__init__("; ".join([*parts, *([detail] if detail else [])]))


@contextmanager
def store_context(store: str):
    """Names the store in format errors raised within."""
    try:
        yield
    except DGGSFormatError as e:
        raise DGGSFormatError(e.check, e.declared, e.observed, e.store or store, e.conventions, e.detail) from e
