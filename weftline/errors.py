"""Expected failures and the exit codes that a command gives for them."""

from __future__ import annotations


class WeftlineError(Exception):
    """A plan or apply step that can't be done."""

    exit_code = 1


class VerificationError(WeftlineError):
    """Manifest and active rows disagree."""

    exit_code = 2


class BackendError(WeftlineError):
    """An index or cache can't complete an operation."""

    exit_code = 3


class ProviderError(WeftlineError):
    """An embedding provider can't complete an operation."""

    exit_code = 3


class TransientProviderError(ProviderError):
    """A provider failure that may be tried again."""


class ConfigError(WeftlineError):
    """A configuration is absent, malformed or inconsistent."""

    exit_code = 4
