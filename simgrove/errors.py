"""Errors with the stable problem id that a service would report."""


class ProblemError(ValueError):
    def __init__(self, problem: str, message: str):
        super().__init__(message)
        self.problem = problem


def unknown_document(doc_id) -> ProblemError:
    return ProblemError("unknown-document", f"no document has the id {doc_id!r}")
