"""Importing this module registers every query."""

import suite.reports  # noqa: F401
import suite.inputs  # noqa: F401
import suite.requests  # noqa: F401
import suite.returns  # noqa: F401
