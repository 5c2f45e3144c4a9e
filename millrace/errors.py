"""Refusals: a query that cannot be answered is refused with a code, a message and a remedy, not answered empty."""


class InvalidQuery(ValueError):
    def __init__(self, message: str, remedy: str, code: str = "INVALID_ARGUMENT"):
        super().__init__(f"{code}: {message} - {remedy}")
        self.code, self.message, self.remedy = code, message, remedy
