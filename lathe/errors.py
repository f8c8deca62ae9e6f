"""The engine's errors."""


class LatheError(Exception):
    code = "LATHE_ERROR"


class BundleError(LatheError):
    code = "BUNDLE_ERROR"


class RegistryError(LatheError):
    code = "REGISTRY_ERROR"


class ValidationError(LatheError):
    code = "VALIDATION_ERROR"


class NotFittedError(LatheError):
    code = "NOT_FITTED"

    def __init__(self, message: str = "the model is not fitted"):
        super().__init__(message)


class DisposedError(LatheError):
    code = "DISPOSED"

    def __init__(self, message: str = "the model has been disposed"):
        super().__init__(message)
