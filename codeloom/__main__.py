"""python -m codeloom"""

import sys

from .cli import main

sys.exit(main())
