import sys

from lattica.cli import main

sys.exit(main())
