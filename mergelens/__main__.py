"""Command line."""

import sys

from mergelens.plans.review import main

sys.exit(main())
