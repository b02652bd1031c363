"""The command line: see `strataquery.operations`."""

import sys

from strataquery.operations import main

sys.exit(main(sys.argv[1:]))
