"""The errors that callers see."""


class InvalidInput(ValueError):
    """The request itself is wrong; nothing was touched."""


class TransferError(RuntimeError):
    """The request was fine, the work failed."""


class TornChange(TransferError):
    """A change leaves a cell out that no earlier change and no current row holds."""


class MultiTransferError(TransferError):
    """Some tables of a run failed; report has the outcome of each."""

    def __init__(self, report) -> None:
        self.report = report
        bad = [t.table for t in report.tables if t.error]
        super().__init__(f"{len(bad)} of {len(report.tables)} tables failed: {', '.join(bad)}")

    def __reduce__(self):
        return (type(self), (self.report,))
