"""Run the command line."""

import sys

from rillworks.cli import main

sys.exit(main())
