import sys

from skein.cli import main

sys.exit(main())
