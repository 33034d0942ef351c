"""Errors that the package raises. A command-line caller maps any of them to exit code 2."""


class RavennaError(Exception):
    """Base of all errors of this package."""


class ConfigError(RavennaError):
    """A setting or an input file is missing or contradicts another."""


class MissingArtifactError(RavennaError):
    """A model, index or table that the call needs is not there."""


class IncompatibleArtifactError(RavennaError):
    """A stored artifact was built from other data or settings."""


class NoGoldError(RavennaError):
    """A metric was asked for a question without relevant chunks."""


class LeakageError(RavennaError):
    """Evaluation-only text would reach a retriever."""


class FrozenCorpusError(RavennaError):
    """A frozen corpus would be overwritten, or differs from its manifest."""
