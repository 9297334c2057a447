import sys

from lakeloom.cli import main

sys.exit(main())
