from siteloom.cli import main

raise SystemExit(main())
