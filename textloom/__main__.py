import sys

from textloom.cli import main

sys.exit(main())
