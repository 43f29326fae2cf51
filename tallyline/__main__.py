import sys

from tallyline.cli import main

sys.exit(main())
