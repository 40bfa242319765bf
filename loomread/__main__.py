import sys

from loomread.cli import main

sys.exit(main())
