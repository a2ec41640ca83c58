from sparkweave.cli import main

raise SystemExit(main())
