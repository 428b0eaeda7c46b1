import sys

from segmill.cli import main

sys.exit(main())
