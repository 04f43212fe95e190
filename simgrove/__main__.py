import sys

from simgrove.cli import main

sys.exit(main())
