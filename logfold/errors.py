"""Errors of the library, by kind."""


class LogfoldError(Exception):
    """Base of all errors; ``kind`` names the class of fault, ``context`` what was being done."""

    kind = "other"

    def __init__(self, message: str, context: str = ""):
        super().__init__(f"{context}: {message}" if context else message)
        self.message, self.context = message, context


def _kind(name: str, doc: str) -> type[LogfoldError]:
    label = "".join("_" + c.lower() if c.isupper() else c for c in name).strip("_").removesuffix("_error")
    return type(name, (LogfoldError,), {"__doc__": doc, "kind": label})


ParseError = _kind("ParseError", "A text, schema or file does not follow its grammar.")
BufferTooShortError = _kind("BufferTooShortError", "A payload ends before its schema does.")
UnsupportedError = _kind("UnsupportedError", "A feature that is not implemented on purpose.")
UnknownCodecError = _kind("UnknownCodecError", "No codec has this name.")
TypeNotFoundError = _kind("TypeNotFoundError", "A schema refers to a type it does not hold.")
EncodeError = _kind("EncodeError", "A value does not fit its target.")
FormatError = _kind("FormatError", "A container file is damaged or of another format.")
NotFoundError = _kind("NotFoundError", "A rule's source is not in the recording.")
TopicCollisionError = _kind("TopicCollisionError", "Two topics would get the same name.")
TypeCollisionError = _kind("TypeCollisionError", "Two types with different schemas would get the same name.")
InvalidRuleError = _kind("InvalidRuleError", "A rename rule cannot be read.")
